"""Line deduplication across documents, with DataFrame functions only.

Long lines are hashed; the hashes are range-partitioned with a secondary sort
by document (descending) and position, and a streaming window over that order
marks first occurrences.  The result of the search is a compressed bitmap of
lines per document rather than text.

Skew: a line that is in a third of all documents would land in one range.  The
range key therefore carries a salt of the document, so each (hash, salt) run is
short; runs are pre-aggregated to one row each before the totals per hash are
taken.  Labelling joins two plain shuffles, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.storage import settle
from canopy.llm.common import document_key, key_join, let

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Salts of a hash at least, and the lines for which there is one more; a hot line is split into that many runs.
SALTS, LINES = 64, 1 << 20


def _folded(c: Column) -> Column:
    """A-Z in lower case, other characters as they are."""
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def dropped_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_key, dropped): the lines that repeat elsewhere.

    ``dropped`` maps a word number w to 64 bits; bit b is set if line 64 w + b
    goes.  Words without a set bit are absent, and so are documents that lose
    nothing.  A key found in at least ``min_docs`` different doc_ids loses its
    lines everywhere but in the largest doc_id that holds it.  A null doc_id
    counts as no document and its lines stay.
    """
    lines = docs.select(*document_key(), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = (
        lines.where(F.col("doc_id").isNotNull() & (F.char_length("line") >= min_chars))
        .select("doc_id", "text_key", "pos", F.btrim("line", F.lit(BLANKS)).alias("line"))
        .where(F.char_length("line") >= min_chars)
        .select("doc_id", "text_key", "pos", _folded(F.col("line")).alias("key"))
        .select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    rows = settle(keys, "lines")
    salts = max(SALTS, rows.count() // LINES)
    run = ["h1", "h2", "salt"]
    ranged = (
        rows.select("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "doc_id", "pos")
        .repartitionByRange(*run)
        .sortWithinPartitions(*run, F.desc("doc_id"), "pos")
    )
    before = F.lag("doc_id").over(Window.partitionBy(*run).orderBy(F.desc("doc_id"), "pos"))
    firsts = ranged.withColumn("before", before).where("before is null or before <> doc_id")
    heads = firsts.groupBy(*run).agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id"))
    shared = (
        heads.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last_id").alias("last_id"))
        .where(F.col("n") >= min_docs).select("h1", "h2", "last_id")
    )
    shared = settle(shared, "shared-lines")
    bits = (
        rows.join(shared, ["h1", "h2"]).where("doc_id <> last_id")
        .groupBy("doc_id", "text_key", F.shiftright("pos", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    )
    return bits.groupBy("doc_id", "text_key").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped")
    )


def _keep(lines: Column, dropped: Column) -> Column:
    """Lines whose bit is not set; the words are laid out by their numbers once."""
    none = F.lit(0).cast("long")
    words = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys(dropped))), lambda w: F.coalesce(dropped[w], none))

    def kept(laid):
        def stays(_, i):
            return F.getbit(F.coalesce(F.get(laid, F.shiftright(i, 6)), none), F.pmod(i, F.lit(64))) == 0

        return F.filter(lines, stays)

    return let(words, kept)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines that many documents share.

    Returns (doc_id, n_lines, n_dropped, kept_text) and the columns ``keep``, a
    row per row of ``docs``.
    Text is split at \\n; a null or empty text is one empty line.  Keys are
    lines without blanks at both ends and with A-Z lower-cased; keys under
    ``min_chars`` code points always stay.  Repeats of a line inside the
    document that keeps it stay.  Rows that share a doc_id count as one document.
    Columns of ``keep`` that have the name of a result are passed over.
    """
    keep = tuple(k for k in keep if k not in ("doc_id", "n_lines", "n_dropped", "kept_text", "text"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep)
    marks = dropped_bitmaps(base, min_chars, min_docs)
    both = key_join(base.select("*", document_key()[1]), marks)
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(
        F.array_join(_keep(lines, F.col("dropped")), "\n")
    )
    gone = F.aggregate(F.map_values("dropped"), F.lit(0), lambda a, b: a + F.bit_count(b))
    return both.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
        *keep,
    )

"""Exact deduplication by composable polynomial fingerprints.

A text is a polynomial in base 256 with its bytes as coefficients, taken modulo
a 120-bit prime.  Fingerprints of adjoining chunks combine by
``f(AB) = f(A) * 256^|B| + f(B)``, so the chunks of a huge document can be
hashed apart, in any grouping.  Rows whose fingerprint and length agree are then
compared with a representative, chunk by chunk, in a streaming pass; rows that
differ after all form classes of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.storage import settle
from canopy.llm.common import as_bytes, column, document_key, key_join, slices, small_batches

#: The modulus: the largest prime below 2**120.
MODULUS = 2**120 - 119
CHUNK = 1 << 16
#: Bytes of a text from which on its chunks are hashed apart, and of such a chunk.
HUGE, PART = 16 << 20, 4 << 20
#: Members of a group that one run of the comparison takes.
RUN = 256

_RUNS = re.compile(rb"[\x09-\x0d][\x20\x09-\x0d]*|\x20[\x20\x09-\x0d]+")


def normalised(text: bytes) -> bytes:
    """Every run of ASCII blanks as one space."""
    return _RUNS.sub(b" ", text)


def combine(a: tuple[int, int], b: tuple[int, int], modulus: int = MODULUS) -> tuple[int, int]:
    """(fingerprint, length) of two adjoining pieces; associative."""
    return (a[0] * pow(256, b[1], modulus) + b[0]) % modulus, a[1] + b[1]


def chunk_fingerprints(text: bytes, modulus: int = MODULUS, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    for at in range(0, len(text), chunk):
        part = text[at : at + chunk]
        yield int.from_bytes(part, "big") % modulus, len(part)


def fingerprint(text: bytes, modulus: int = MODULUS, chunk: int = CHUNK) -> tuple[int, int]:
    return reduce(lambda a, b: combine(a, b, modulus), chunk_fingerprints(text, modulus, chunk), (0, 0))


def piece(text: bytes, modulus: int = MODULUS) -> tuple[int, int, bool, bool]:
    """(fingerprint, length, starts with a space, ends with one) of a normalised piece."""
    return (*fingerprint(text, modulus), text[:1] == b" ", text[-1:] == b" ")


def join(a: tuple[int, int, bool, bool], b: tuple[int, int, bool, bool], modulus: int = MODULUS) -> tuple[int, int, bool, bool]:
    """The piece of two adjoining ones; associative.  Where a run of blanks was cut, the second space is taken off."""
    if not a[1] or not b[1]:
        return b if b[1] else a
    f, n, ends = b[0], b[1], b[3]
    if a[3] and b[2]:
        n -= 1
        f, ends = (f - 32 * pow(256, n, modulus)) % modulus, b[3] if n else True
    return (*combine(a[:2], (f, n), modulus), a[2], ends)


def same_text(a: bytes, b: bytes, chunk: int = CHUNK) -> bool:
    """Compare chunk by chunk, stopping at the first difference."""
    return len(a) == len(b) and all(a[i : i + chunk] == b[i : i + chunk] for i in range(0, len(a), chunk))


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.binary()), ("n_bytes", pa.int64()), ("text_sha256", pa.string())])


def _parts(modulus: int):
    """Pieces of the parts of huge texts."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "part"):
            found = [piece(normalised(x), modulus) for x in column(b, "part").to_pylist()]
            cols = [pa.array([f[0].to_bytes(16, "big") for f in found], pa.binary()), *(pa.array([f[i] for f in found]) for i in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "text_key"), column(b, "nth"), *cols], names=["doc_id", "text_key", "nth", "fp", "n", "starts", "ends"])

    return work


def huge_fingerprints(huge: DataFrame, modulus: int = MODULUS, part: int = PART) -> DataFrame:
    """(doc_id, text_key, pieces) of different documents of huge texts: what their parts give, in order."""
    raw = huge.groupBy("doc_id", "text_key").agg(F.any_value(F.col("text").cast("binary")).alias("raw"))
    count = F.ceil(F.octet_length("raw") / part).cast("int")
    cut = raw.select("doc_id", "text_key", "raw", F.explode(F.sequence(F.lit(0), count - 1)).alias("nth"))
    cut = cut.select("doc_id", "text_key", "nth", F.substring("raw", F.col("nth") * part + 1, F.lit(part)).alias("part"))
    dealt = cut.repartition("doc_id", "text_key", "nth")
    found = dealt.mapInArrow(_parts(modulus), "doc_id long, text_key long, nth int, fp binary, n long, starts boolean, ends boolean")
    return found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("nth", "fp", "n", "starts", "ends"))).alias("pieces"))


def _digest(modulus: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [normalised(x) for x in as_bytes(b)]
            pieces = column(b, "pieces").to_pylist() if "pieces" in b.schema.names else [None] * len(texts)
            prints = [_joined(own, modulus) if own else fingerprint(x, modulus) for x, own in zip(texts, pieces, strict=True)]
            yield pa.record_batch(
                [column(b, "doc_id"), column(b, "text_key"), pa.array([f.to_bytes(16, "big") for f, _ in prints], pa.binary()),
                 pa.array([n for _, n in prints], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts])],
                schema=_DIGESTS,
            )

    return work


def _joined(pieces: list[dict], modulus: int) -> tuple[int, int]:
    found = [(int.from_bytes(p["fp"], "big"), p["n"], p["starts"], p["ends"]) for p in pieces]
    return reduce(lambda a, b: join(a, b, modulus), found)[:2]


_DIFFERENT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64())])


def _different(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (fp, n_bytes, run) with the representative first: those that differ from it."""
    group, head = None, b""
    for b in slices(batches):
        bad = []
        keys = zip(column(b, "fp").to_pylist(), column(b, "n_bytes").to_pylist(), column(b, "run").to_pylist(), strict=True)
        for i, (key, first, raw) in enumerate(zip(keys, column(b, "first").to_pylist(), as_bytes(b), strict=True)):
            text = normalised(raw)
            if key != group:
                assert first, "a run starts with its representative"
                group, head = key, text
            elif not same_text(head, text):
                bad.append(i)
        got = b.take(pa.array(bad, pa.int64()))
        yield pa.record_batch([column(got, "doc_id"), column(got, "text_key")], schema=_DIFFERENT)


def exact_dedup(docs: DataFrame, modulus: int = MODULUS, huge: int = HUGE, part: int = PART) -> DataFrame:
    """Group rows whose texts are equal up to runs of blanks.

    Returns (doc_id, keep_id, group_size, kept, text_sha256), a row per row of
    ``docs``.  ``keep_id`` is the smallest doc_id of the group; a null text is
    an empty one, and a null doc_id is the largest id: such a row stays only if
    no row of its group has an id.  If rows repeat the smallest id, each of them
    is marked as kept.  A smaller ``modulus`` only makes more work.

    Groups of any size are split into runs of about RUN members for the
    comparison, each with a copy of the representative; counts are
    pre-aggregated before the shuffle.  Rows that repeat a document whole are
    compared once.  Other columns of ``docs`` are not read.

    Texts of more than HUGE bytes are cut into chunks that are normalised and
    hashed in tasks of their own; what they give is combined per text.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", document_key()[1])
    small_batches(docs.sparkSession)
    fields, is_huge = "doc_id long, text_key long, fp binary, n_bytes long, text_sha256 string", F.octet_length("text") > huge
    digests = base.where(~is_huge).mapInArrow(_digest(modulus), fields)
    long_texts = base.where(is_huge)
    if not long_texts.select("doc_id").isEmpty():
        digests = digests.unionByName(key_join(long_texts, huge_fingerprints(long_texts, modulus, part)).mapInArrow(_digest(modulus), fields))
    digests = settle(digests, "digests")
    key = ["fp", "n_bytes"]
    groups = digests.groupBy(*key).agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("head")
    )
    groups = settle(groups.where("n > 1").select(*key, "n", "head"), "groups")
    # rows that repeat a document are counted first, so that a group is dealt by its documents
    documents = digests.groupBy("doc_id", "text_key", *key).agg(F.count("*").alias("rows"))
    members = documents.join(groups, key).select(
        "doc_id", "text_key", *key, "rows",
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))).alias("first"),
        F.ceil(F.col("n") / RUN).cast("int").alias("runs"),
    )
    members = settle(members, "members")
    # the representative goes to every run
    heads = members.where("first").drop("rows").withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)))
    others = members.where("not first").drop("rows").withColumn("run", F.pmod(F.xxhash64("doc_id", "text_key"), F.col("runs")).cast("int"))
    dealt = heads.unionByName(others).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*key, "run", "first")).alias("to"))
    # by a merge join at every size: what is small in one table may be a third of another
    texts = key_join(base, dealt.hint("merge"), "inner")
    if not members.where("rows > 1").isEmpty():  # one of the rows that repeat a document is enough
        texts = texts.groupBy("doc_id", "text_key").agg(F.any_value("text").alias("text"), F.any_value("to").alias("to"))
    sent = texts.select("doc_id", "text_key", "text", F.explode("to").alias("to")).select("doc_id", "text_key", "text", "to.*")
    ordered = sent.repartition(*key, "run").sortWithinPartitions(*key, "run", F.desc("first"))
    different = ordered.mapInArrow(_different, "doc_id long, text_key long").distinct().withColumn("differs", F.lit(True))
    classes = settle(
        key_join(digests, different).withColumn("own", F.when(F.col("differs"), F.col("text_sha256")).otherwise("")).drop("differs"), "classes"
    )
    key = [*key, "own"]
    sizes = classes.groupBy(*key).agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).where("n > 1")
    sizes = settle(sizes, "class-sizes")
    return classes.join(sizes, key, "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("n").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("low"))).alias("kept"),
        "text_sha256",
    )

"""Near copies by the similarity of their shingles: Jaccard of at least 4/5 over shingles of five words.

SimHash proposes pairs, but no radius of it guarantees a similarity.  Texts of
that similarity share a shingle among the first n - ceil(4n/5) + 1 of their n
shingles in any order that all texts use (prefix filter), so an index of those
prefixes meets every pair.  The order has shingles that are common in a sample
last, which only saves work.  The first shingle that two texts share, at places
i and j, leaves them at most n - i and m - j in common; so each entry of the
index tells the largest partner that it allows (position filter), and a list
keeps only entries that may allow each other.  A set's shingles are also told by
the parities of their numbers in 512 bins: similar sets of n and m differ in at
most (n + m) / 9 shingles, so in no more bins (bin filter).  All proposed pairs
that this leaves are checked on whole texts; equality of shingles rests on
64-bit hashes.

A list of the index first proposes each member with its smallest one.  After
those are checked, it proposes pairs that are not grouped yet, of sizes that
allow each other.  Two sets that share the shingle before, too, have met there.
The sets of long lists are indexed again by themselves, in an order that their
own shingles give, until that no longer halves them: similar sets that meet in
a long list both are among those.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.storage import release, settle
from canopy.llm.common import as_bytes, column, document_key, forget, key_join, slices, small_batches
from canopy.llm.near_dedup import fingerprint, links
from canopy.llm.suffix_dedup import Hashes
from canopy.operators.graph import components

WIDTH, SEED = 5, 42
#: Texts whose shingles are counted for the order, and common shingles that it knows; results do not depend on them.
SAMPLE_SETS, COMMON = 16_384, 1 << 17
#: Groups of a list beyond which its sets are indexed again, and the ratio of sizes of a class: over 5/4, so that similar sets are of one class or of neighbours.
LONG, CLASS = 8, 1.3
#: Hashes that a task keeps of the texts it has compared.
KNOWN = 1 << 21
#: Words of 64 bins whose parities tell sets apart.
WORDS = 8
PARITIES = [f"p{k}" for k in range(WORDS)]


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of all shingles; words as for SimHash.  Fewer words make one shingle; none give none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(len(words) - WIDTH + 1, 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return np.unique(Hashes(np.frombuffer(b" ".join(words), np.uint8)).of((ends - sizes)[:n], ends[len(words) - n :]))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def parities(s: np.ndarray) -> np.ndarray:
    """The parities of the numbers of shingles in each bin, in WORDS words."""
    counts = np.bincount((s % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view("<i8")


def _may(a: str, b: str) -> Column:
    """Whether two structs of n and parities may be of similar sets: bins that differ hold a shingle that differs."""
    differ = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in PARITIES), F.lit(0))
    return 9 * differ <= F.col(f"{a}.n") + F.col(f"{b}.n")


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which two similar sets share one."""
    rank = np.zeros(len(s), np.int64)
    if len(common) and len(s):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rank = np.where(common[at] == s, counts[at], 0)
    return s[np.lexsort((s, rank))[: len(s) - -(-4 * len(s) // 5) + 1]]


def _prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in slices(batches):
        texts = as_bytes(b)
        found = [shingles(x) for x in texts]
        keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64)
        fps = np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)
        words = np.stack([parities(s) for s in found], 1)
        cols = [column(b, "doc_id"), column(b, "text_key"), pa.array(keys), pa.array(fps), pa.array([len(s) for s in found], pa.int64()), *map(pa.array, words)]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", "set_key", "fp", "n", *PARITIES])


def _all_shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in slices(batches):
        found = [shingles(x) for x in as_bytes(b)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])


def _entries(common: np.ndarray, counts: np.ndarray):
    """For each shingle of a prefix: the size n of the set, and u, the size of the largest set that may be similar and share it first."""
    shared = [common, counts]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in slices(batches):
            found = [shingles(x) for x in as_bytes(b)]
            first = [prefix(s, *shared) for s in found]
            sizes = np.array([len(x) for x in first])
            keys = np.repeat(column(b, "set_key").to_numpy(), sizes)
            n = np.repeat(np.array([len(s) for s in found], np.int64), sizes)
            place = np.arange(len(n)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # similar sets of n and m have 4/9 of n + m in common, and n - place at most
            most = (5 * n - 9 * place) // 4
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(n.astype(np.int32)), pa.array(most.astype(np.int32)), pa.array(keys)], names=["h", "n", "u", "set_key"])

    return work


def _plausible(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Of rows sorted by (h, n, set_key): those whose list has, before them, one that allows their size or, next, one of a size that they allow."""
    last, allowed = None, np.int64(-1)
    for b in batches:
        cur = [column(b, c).to_numpy().astype(np.int64) for c in ("h", "n", "u", "set_key")]
        if not len(cur[0]):
            continue
        cur = [np.concatenate([k, c]) for k, c in zip(last, cur, strict=True)] if last else cur
        h, n, u, _ = cur
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        own = np.cumsum(first) << 32
        reach = own + u + 1
        reach[0] = own[0] + max(u[0], allowed) + 1
        before = np.append(allowed, np.maximum(np.maximum.accumulate(reach)[:-1] - own[1:] - 1, -1))
        before[first & (np.arange(len(h)) > 0)] = -1
        keep = before >= n
        keep[:-1] |= ~first[1:] & (n[1:] <= u[:-1])
        yield [c[:-1][keep[:-1]] for c in cur]
        last, allowed = [c[-1:] for c in cur], before[-1]
    if last and allowed >= last[1][0]:
        yield last


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plausible rows of lists of two or more, with the first of their list."""
    forget()
    kept = None  # the last row, which may go on in the next batch, and the first of its list
    for cur in _plausible(batches):
        if not len(cur[0]):
            continue
        cur = [np.concatenate([k, c]) for k, c in zip(kept[0], cur, strict=True)] if kept else cur
        first = np.ones(len(cur[0]), bool)
        first[1:] = cur[0][1:] != cur[0][:-1]
        at = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        heads = [c[at] for c in cur[1:]]
        is_first = first.copy()
        if kept:
            for head, was in zip(heads, kept[1], strict=True):
                head[at == 0] = was
            is_first[0] = kept[2]
        out = np.flatnonzero(~is_first[:-1] | ~first[1:])
        kept = [c[-1:] for c in cur], [x[-1] for x in heads], bool(is_first[-1])
        yield _list_rows([c[out] for c in [*cur, *heads]])
    if kept and not kept[2]:
        yield _list_rows([*kept[0], *[np.array([x]) for x in kept[1]]])


def _list_rows(cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["h", "n", "u", "set_key", "head_n", "head_u", "head"])


def _check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    known: dict[int, np.ndarray] = {}
    size = 0
    for b in slices(batches, "a_text"):
        good = []
        pairs = [column(b, "u").to_pylist(), column(b, "v").to_pylist()], [as_bytes(b, "a_text"), as_bytes(b, "b_text")]
        for row in zip(*pairs[0], *pairs[1], strict=True):
            for name, text in zip(row[:2], row[2:], strict=True):
                if name not in known:
                    known[name] = shingles(text)
                    size += len(known[name])
            good.append(similar(known[row[0]], known[row[1]]))
            if size > KNOWN:
                known, size = {}, 0
        yield pa.RecordBatch.from_arrays([column(b, "u"), column(b, "v")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (u, v) of set_key, those of similar sets."""
    a = sets.select(F.col("set_key").alias("u"), F.col("text").alias("a_text"))
    b = sets.select(F.col("set_key").alias("v"), F.col("text").alias("b_text"))
    return settle(pairs.join(a, "u").join(b, "v").select("u", "v", "a_text", "b_text").mapInArrow(_check, "u long, v long"), "alike")


def _likely(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Of pairs (u, v) of set_key, those that the bins leave."""
    mark = F.struct("n", *PARITIES)
    a, b = (marks.select(F.col("set_key").alias(key), mark.alias(name)) for key, name in (("u", "a"), ("v", "b")))
    return settle(pairs.join(a, "u").join(b, "v").where(_may("a", "b")).select("u", "v"), "likely")


def most_common(often: DataFrame) -> DataFrame:
    """Rows of (h, n) with the largest n, COMMON of them at most; of equal n all or none, so that tasks need not send what others outdo."""
    least, room = None, COMMON
    for n, rows in sorted(map(tuple, often.groupBy("n").agg(F.count("*").alias("rows")).collect()), reverse=True):
        room -= rows
        if room < 0:
            break
        least = n
    return often.where(F.lit(False) if least is None else F.col("n") >= least)


def index_lists(sets: DataFrame) -> DataFrame:
    """(h, n, u, set_key, head_n, head_u, head): the lists of the prefix index that hold two plausible sets or more, with the smallest of each."""
    share = max(1, sets.count() // SAMPLE_SETS)
    drawn = sets.where(F.pmod("set_key", F.lit(share)) == 0).select("text").mapInArrow(_all_shingles, "h long")
    often = settle(drawn.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "often")
    often = most_common(often).collect()
    common, counts = np.array([r.h for r in often], np.int64).view(np.uint64), np.array([r.n for r in often], np.int64)
    order = np.argsort(common)
    entries = sets.mapInArrow(_entries(common[order], counts[order]), "h long, n int, u int, set_key long")
    met = entries.repartition("h").sortWithinPartitions("h", "n", "set_key")
    return settle(met.mapInArrow(_lists, "h long, n long, u long, set_key long, head_n long, head_u long, head long"), "met")


def mixed(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, n, u, set_key, root, before, many): the lists with sets of several groups, their number, and the list of each set before."""
    met = lists.select("h", "n", "u", "set_key").join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    met = settle(met, "rooted")
    many = met.select("h", "root").distinct().groupBy("h").agg(F.count("*").alias("many")).where("many > 1")
    # u falls from place to place of a set
    out = met.join(many, "h").withColumn("before", F.lag("h").over(Window.partitionBy("set_key").orderBy(F.desc("u"))))
    out = settle(out, "mixed")
    release(met)
    return out


def meetings(groups: DataFrame) -> DataFrame:
    """(m, o): the sets of two groups of a list that may be similar and have not met in the list before."""
    names = {"root": "other", "before": "other_before", "low": "other_low", "high": "other_high", "m": "o", "size": "other_size"}
    others = groups.select("h", *[F.col(k).alias(v) for k, v in names.items()])
    others = others.withColumn("size", F.explode(F.array("other_size", F.col("other_size") - 1)))
    apart = F.when(F.col("size") == F.col("other_size"), F.col("root") < F.col("other")).otherwise(F.col("root") != F.col("other"))
    new = F.coalesce(F.col("before") != F.col("other_before"), F.lit(True))
    return groups.join(others, ["h", "size"]).where(apart & new).where("low <= other_high and other_low <= high").select("m", "o")


def _crossed(met: DataFrame, marks: DataFrame) -> DataFrame:
    """(u, v): pairs of sets of different groups in a list, of those that the index and the bins leave."""
    sized = met.join(marks.drop("n"), "set_key").withColumn("size", F.floor(F.log("n") / F.log(F.lit(CLASS))))
    groups = sized.groupBy("h", "size", "root", "before").agg(F.min("n").alias("low"), F.max("u").alias("high"), F.collect_list(F.struct("n", "u", "set_key", *PARITIES)).alias("m"))
    groups = settle(groups, "groups")
    cross = meetings(groups).select(F.explode("m").alias("x"), "o").select("x", F.explode("o").alias("y"))
    cross = cross.where("x.n <= y.u and y.n <= x.u").where(_may("x", "y")).select(*_pair("x.set_key", "y.set_key")).distinct()
    cross = settle(cross, "crossed")
    release(groups)
    return cross


def _crossings(sets: DataFrame, lists: DataFrame, roots: DataFrame, marks: DataFrame) -> list[DataFrame]:
    """Tables (u, v) of pairs of sets of different groups that may be similar; every similar one is in one of them.  Releases ``lists``."""
    found, todo, number = [], sets, sets.count()
    while True:
        met = mixed(lists, roots)
        release(lists)
        long = settle(met.where(F.col("many") > LONG).select("set_key").distinct(), "long")
        rest = long.count()
        last = not 0 < rest <= number // 2
        found.append(_crossed(met if last else met.where(F.col("many") <= LONG), marks))
        release(met)
        if not last:
            again = settle(todo.join(long, "set_key", "left_semi"), "again")
        release(long)
        if todo is not sets:
            release(todo)
        if last:
            return found
        todo, number = again, rest
        lists = index_lists(todo)


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, component), a row per row of ``docs``: documents that are similar, directly or through others.

    Wordless texts, null among them, are copies of one another.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(*document_key(), "text")
    schema = "doc_id long, text_key long, set_key long, fp long, n long, " + ", ".join(f"{p} long" for p in PARITIES)
    prints = settle(keyed.mapInArrow(_prints, schema), "prints")
    marks = settle(prints.groupBy("set_key").agg(F.any_value("n").alias("n"), *[F.any_value(p).alias(p) for p in PARITIES]), "marks")
    # one text of each set of shingles; SimHash counts repeats, so a set may have several fingerprints
    one = prints.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select("set_key", "k.*")
    sets = key_join(keyed, one, "inner").select("set_key", "text")
    if not prints.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        sets = sets.dropDuplicates(["set_key"])  # rows that repeat a document whole
    sets = settle(sets, "sets")

    fps = settle(prints.groupBy("fp").agg(F.min("set_key").alias("low")), "fps")
    same = prints.join(fps, "fp").select(*_pair("low", "set_key"))
    by_bits = links(fps.select("fp")).join(fps.select(F.col("fp").alias("u"), F.col("low").alias("a")), "u")
    by_bits = by_bits.join(fps.select(F.col("fp").alias("v"), F.col("low").alias("b")), "v").select(*_pair("a", "b"))
    lists = index_lists(sets)
    starred = lists.where("n <= head_u and head_n <= u").select(*_pair("head", "set_key"))
    pairs = settle(same.unionByName(by_bits).unionByName(starred).where("u <> v").distinct(), "pairs")
    release(fps)
    likely = _likely(pairs, marks)
    alike = _checked(likely, sets)
    release(likely)

    roots = components(alike).withColumnRenamed("u", "set_key")
    found = _crossings(sets, lists, roots, marks)
    cross = reduce(DataFrame.unionByName, found).distinct()
    cross = settle(cross.join(pairs, ["u", "v"], "left_anti"), "cross")
    release(pairs, marks, *found)
    more = _checked(cross, sets)
    release(cross, sets)
    roots = components(alike.unionByName(more)).withColumnRenamed("u", "set_key")
    return prints.join(roots, "set_key", "left").select("doc_id", "text_key", F.coalesce("root", "set_key").alias("component"))

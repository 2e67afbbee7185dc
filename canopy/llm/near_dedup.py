"""Near-duplicate documents by SimHash fingerprints of 64 bits.

Fingerprints that differ in at most four bits share at least four of their eight
bytes, byte for byte and place for place.  The inverted index is therefore keyed
by four byte positions and their bytes: a pair meets in a list exactly when
those four are shared, which is the guaranteed minimum of the count filter.  A
list owns a pair only if its positions are the first four that the pair shares,
so the tally of each pair is taken once.  Owned pairs are verified by their
Hamming distance, and each list emits a spanning forest of its links, never all
pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.storage import settle
from canopy.llm.common import as_bytes, column, slices, small_batches
from canopy.operators.graph import components

#: Members of a list that one block holds; a longer list is met block against block.
BLOCK = 2048
MAX_BITS = 4
#: Fingerprints of one task that makes entries of them, and such tasks at most.
SPREAD, MOST_TASKS = 8192, 50_000
PLACES = list(combinations(range(8), 4))
#: For each set of equal byte positions, the list that owns a pair, or -1 if under four are equal.
OWNER = np.array(
    [PLACES.index(tuple(same[:4])) if len(same) >= 4 else -1 for m in range(256) for same in [[p for p in range(8) if m >> p & 1]]], np.int16
)
_STRIPE = 1 << 16


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """SimHash over the XXH64 of every shingle of ``width`` words, repeats included.

    Words are runs without ASCII blanks, A-Z lower-cased.  Fewer words make one
    shingle; none give zero.
    """
    words = text.lower().split()
    n = max(len(words) - width + 1, 1)
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()[:n]
    stops = ends.tolist()[len(words) - n :]
    h = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _STRIPE):
        hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[at : at + _STRIPE], stops[at : at + _STRIPE], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def _fingerprints(width: int, seed: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(x, width, seed) for x in as_bytes(b)], np.uint64)
            yield pa.record_batch([column(b, "doc_id"), pa.array(fps.view(np.int64))], schema=schema)

    return work


def owned_links(a: np.ndarray, b: np.ndarray, place: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """Which pairs a list owns (by the tally of equal bytes) and the distance confirms."""
    x = a ^ b
    octets = np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8)
    same = np.packbits(octets == 0, axis=-1, bitorder="little")[..., 0]
    return (OWNER[same] == place) & (np.bitwise_count(x) <= max_bits)


def forest(fps: np.ndarray, place: int, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links that one list owns among distinct fingerprints."""
    out, left = [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            linked = owned_links(left, node, place, max_bits)
            if linked.any():
                near, left = left[linked], left[~linked]
                out += [(int(node), int(x)) for x in near]
                queue += list(near)
    return out


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _link_lists(max_bits: int):
    """Over rows sorted by list: the links of each list.  Lists hold two blocks at most."""

    def solve(place: np.ndarray, fps: np.ndarray, first: np.ndarray) -> list:
        bounds = np.append(np.flatnonzero(first), len(fps))
        sizes = np.diff(bounds)
        edges = []
        two = bounds[:-1][sizes == 2]  # the bulk, all at once
        if len(two):
            x = fps[two] ^ fps[two + 1]
            same = np.packbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0, axis=-1, bitorder="little")[:, 0]
            good = two[(OWNER[same] == place[two]) & (np.bitwise_count(x) <= max_bits)]
            edges += list(zip(fps[good].view(np.int64).tolist(), fps[good + 1].view(np.int64).tolist(), strict=True))
        for s, n in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            links = forest(fps[s : s + n], int(place[s]), max_bits)
            edges += np.array(links, np.uint64).view(np.int64).reshape(-1, 2).tolist()
        return edges

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            cur = [column(b, c).to_numpy(zero_copy_only=False) for c in ("place", "key", "lo", "hi", "fp")]
            cur = [np.concatenate([k, c]) for k, c in zip(kept, cur, strict=True)] if kept else cur
            if not len(cur[0]):
                continue
            first = np.ones(len(cur[0]), bool)
            first[1:] = np.any([c[1:] != c[:-1] for c in cur[:4]], axis=0)
            last = int(np.flatnonzero(first)[-1])  # the last list may go on in the next batch
            kept = [c[last:] for c in cur]
            if last:
                yield rows(solve(cur[0][:last], cur[4][:last].view(np.uint64), first[:last]))
        if kept:
            first = np.zeros(len(kept[0]), bool)
            first[0] = True
            yield rows(solve(kept[0], kept[4].view(np.uint64), first))

    def rows(edges: list) -> pa.RecordBatch:
        u, v = zip(*edges, strict=True) if edges else ((), ())
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_EDGES)

    return work


def _list_key(place: int) -> Column:
    """The number of four byte positions and the bytes there, in one number."""
    out = F.lit(place << 32)
    for j, p in enumerate(PLACES[place]):
        byte = F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(0xFF).cast("long"))
        out = out.bitwiseOR(F.shiftleft(byte, 8 * j))
    return out.cast("long")


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column ``fp``) that keep every component whole.

    Lists are counted with partial aggregation first; lists of one are dropped,
    and a list of more than ``block`` members is dealt as pairs of blocks, so no
    task ever holds more than two blocks.  ``max_bits`` is 4 at most.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the count filter guarantees four shared bytes for up to 4 bits only")
    # a few rows become 70 times as many: small files must not make few tasks of them
    tasks = min(max(1, -(-fps.count() // SPREAD)), MOST_TASKS)
    entries = fps.repartition(tasks, "fp").select("fp", F.explode(F.array(*[_list_key(k) for k in range(len(PLACES))])).alias("key"))
    long_lists = settle(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    met = entries.join(long_lists.hint("merge"), "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = F.shiftrightunsigned("key", 32).cast("short").alias("place")
    dealt = met.select(place, "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    cut = ["place", "key", "lo", "hi"]
    ordered = dealt.repartition(*cut).sortWithinPartitions(*cut, "fp")
    return ordered.mapInArrow(_link_lists(max_bits), "u long, v long")


def near_dedup(docs: DataFrame, width: int = 4, seed: int = 42, max_bits: int = MAX_BITS) -> DataFrame:
    """Group documents whose fingerprints are linked, directly or through others.

    Returns (doc_id, fingerprint, component_id), a row per row of ``docs``: the
    fingerprint as 16 hex digits, and the smallest doc_id of the component.  Null
    texts have no words, and all wordless texts share fingerprint zero.  Null ids
    are passed over when the smallest is taken.
    """
    small_batches(docs.sparkSession)
    prints = settle(docs.select("doc_id", "text").mapInArrow(_fingerprints(width, seed), "doc_id long, fp long"), "prints")
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "fps")
    roots = components(settle(links(distinct.select("fp"), max_bits), "links")).withColumnRenamed("u", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    rooted = settle(rooted, "rooted")
    lows = settle(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("n")).where("n > 1").drop("n"), "lows")
    shared = settle(rooted.join(lows, "root").select("fp", "component_id"), "shared")
    return prints.join(shared, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )

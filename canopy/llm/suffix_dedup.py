"""Removal of long byte strings that repeat anywhere in a corpus, by suffix arrays.

Sharding: of each window of PASSAGE bytes the least hash of its K-byte strings is
its anchor, so equal windows have equal anchors at equal places.  Runs of windows
with one anchor, with the bytes that the longer windows of LENGTH bytes need, are
the units ("stretches"); only stretches whose anchor occurs more than once are
looked at.  Equal stretches are counted with partial aggregation, which settles
exact copies.  Two different stretches can share a window only if they agree in
half a window to the left or to the right of their anchor, so one copy of each
different stretch goes to the shards of these two contexts, if another one is
there.  In a shard a suffix array (induced sorting) and the permuted common
prefixes tell which windows occur twice.  A context with so many different
stretches that a shard could not hold them is settled by counting hashed windows
instead, which can be split over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.storage import settle
from canopy.llm.common import as_bytes, column, document_key, key_join, slices, small_batches

LENGTH = 400
#: Windows of this length are found too: passages of over WORDS words that repeat, some shorter than LENGTH, are counted.
PASSAGE = 256
WORDS = 50
K = 32
#: Bytes of a document that are searched for anchors at a time.
PIECE = 1 << 19
#: Bytes of stretches in one suffix array.
SHARD_BYTES = 1 << 20
#: Different stretches of one anchor that a shard takes.
SHARD_STRETCHES = 4096
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _ODD, np.uint64)
    down = np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Hashes:
    """Hashes of any substrings of some bytes, the same wherever a substring stands."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(16, len(data).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start])


def stretches(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, passage: int = PASSAGE, k: int = K, most: int = PIECE) -> dict[str, np.ndarray]:
    """Stretches of joined texts that end at ``ends``; windows start in the first ``most`` bytes of a text.

    lo, hi: the first and the last window.  anchor and h: place and hash of the anchor.  size and ctx: bytes of the stretch
    and their hash.  left and right: hashes of the anchor with half a window beside it, 0 if no window of the stretch has them.
    """
    n = len(data)
    if n < passage:
        return {c: np.zeros(0, np.uint64 if c in ("h", "ctx", "left", "right") else np.int64) for c in ("lo", "hi", "anchor", "h", "size", "ctx", "left", "right")}
    if n >= 1 << 24:
        raise ValueError("pieces must be under 16 MB")
    hashes, width = Hashes(data), passage - k + 1
    at = np.arange(n - k + 1)
    grams = hashes.of(at, at + k)
    place = np.uint64((1 << 24) - 1)
    keyed = (grams & ~place) | at.astype(np.uint64)
    # sliding minimum: of blocks as wide as a window, suffix minima meet prefix minima
    pad = np.full(-len(keyed) % width, np.iinfo(np.uint64).max, np.uint64)
    table = np.concatenate([keyed, pad]).reshape(-1, width)
    prefix = np.minimum.accumulate(table, axis=1).ravel()
    suffix = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    s = np.arange(n - passage + 1)
    anchor = (np.minimum(suffix[s], prefix[s + width - 1]) & place).astype(np.int64)
    sizes = np.diff(ends, prepend=0)
    good = np.zeros(n, bool)
    for stop, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        good[stop - size : max(min(stop - passage + 1, stop - size + most), stop - size)] = True
    good = good[: len(s)]
    first = np.ones(len(s), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1])
    lo = np.flatnonzero(first)
    hi = np.append(lo[1:], len(s)) - 1
    lo, hi = lo[good[lo]], hi[good[lo]]
    # where texts meet, a run must not go on; windows over an end are not good, so a text of at least one window is apart
    owner = np.searchsorted(ends, lo, "right")
    a, stop, half = anchor[lo], np.minimum(hi + length, ends[owner]), (passage - k + 1) // 2
    has_left, has_right = a - half >= lo, a + k + half <= hi + passage
    left, right = np.zeros(len(lo), np.uint64), np.zeros(len(lo), np.uint64)
    left[has_left] = hashes.of(a[has_left] - half, a[has_left] + k)
    right[has_right] = hashes.of(a[has_right], a[has_right] + k + half)
    return {"lo": lo, "hi": hi, "anchor": a, "h": grams[a], "size": stop - lo, "ctx": hashes.of(lo, stop), "left": left, "right": right}


# --- suffix arrays -----------------------------------------------------------


def _ranks_by_doubling(s: np.ndarray) -> np.ndarray:
    """Suffix array of integers by doubling; used for the reduced string of substring names."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    step, n = 1, len(s)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.append(False, key[order][1:] != key[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


def _induce(s, small, heads, tails, sa, filled):
    """Induce larger suffixes from left to right and smaller ones from right to left, a bucket at a time."""
    n = len(s)
    top = heads.copy()
    lists: list[list[np.ndarray]] = [[] for _ in heads]
    start = np.array([n - 1], np.int32)
    # the last suffix precedes all others of its symbol
    _push(s, start, ~small[start], lists)
    for c in range(len(heads)):
        at = 0
        while at < len(lists[c]):
            prev = lists[c][at] - 1
            prev = prev[prev >= 0]
            _push(s, prev[~small[prev]], None, lists)
            at += 1
        own = np.concatenate(lists[c]) if lists[c] else np.zeros(0, np.int32)
        sa[top[c] : top[c] + len(own)] = own
        top[c] += len(own)
        prev = filled[c] - 1
        prev = prev[prev >= 0]
        _push(s, prev[~small[prev]], None, lists)
    lists = [[] for _ in heads]
    for c in range(len(heads) - 1, -1, -1):
        at = 0
        while at < len(lists[c]):
            prev = lists[c][at] - 1
            prev = prev[prev >= 0]
            _push(s, prev[small[prev]], None, lists)
            at += 1
        own = np.concatenate(lists[c]) if lists[c] else np.zeros(0, np.int32)
        sa[tails[c] - len(own) : tails[c]] = own[::-1]
        larger = sa[heads[c] : top[c]][::-1]
        prev = larger - 1
        prev = prev[prev >= 0]
        _push(s, prev[small[prev]], None, lists)
    return sa


def _push(s, positions, mask, lists) -> None:
    """Append positions to the lists of their symbols, in order."""
    if mask is not None:
        positions = positions[mask]
    if not len(positions):
        return
    symbols = s[positions]
    order = np.argsort(symbols, kind="stable")
    positions, symbols = positions[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for part in np.split(positions, cuts):
        lists[s[part[0]]].append(part)


def _names(typed: np.ndarray, left: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Names of the substrings from ``left`` to ``stops`` in their order.

    They are compared by symbols and, of equal symbols, by class, the larger-class
    suffix coming first; an end is below all.  Six symbols of under 1024 are
    compared at a time, and then only substrings that are equal so far go on.
    """
    rank, todo, at, last = np.zeros(len(left), np.int64), np.arange(len(left)), left.copy(), len(typed) - 1
    while len(todo):
        key = np.zeros(len(todo), np.int64)
        for j in range(6):
            p = at[todo] + j
            key = (key << 10) | np.where(p < stops[todo], typed[np.minimum(p, last)], 0)
        order = np.lexsort((key, rank[todo]))
        todo, old, key = todo[order], rank[todo][order], key[order]
        group = np.append(True, old[1:] != old[:-1])
        fresh = group | np.append(True, key[1:] != key[:-1])
        heads, own = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        rank[todo] = old + heads[own] - np.flatnonzero(group)[np.cumsum(group) - 1]
        at[todo] += 6
        go_on = (np.diff(np.append(heads, len(todo))) > 1) & np.logical_or.reduceat(at[todo] < stops[todo], heads)
        todo = todo[go_on[own]]
    return np.unique(rank, return_inverse=True)[1]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of integers under 500 by induced sorting.

    Suffixes are classified as smaller or larger than their successors; the
    leftmost-smaller substrings are sorted and named; the string of names is
    sorted in turn; the order of all suffixes is induced from it, a
    bucket at a time with array operations.
    """
    n = len(s)
    s = s.astype(np.int16)  # places are of 32 bits, symbols of 16: a shard's arrays are what a worker holds
    if n < 2:
        return np.arange(n)
    # smaller: s[i] < s[j] for the next different symbol; the end counts as smallest, so the last suffix is larger
    differ = np.flatnonzero(np.diff(s))
    sign = np.zeros(n, bool)
    upto = np.append(differ, n - 1)
    kind = np.append(s[differ] < s[differ + 1], False)
    sign = np.repeat(kind, np.diff(np.append(-1, upto)))
    left = (np.flatnonzero(sign[1:] & ~sign[:-1]) + 1).astype(np.int32)
    counts = np.bincount(s)
    tails = np.cumsum(counts)
    heads = tails - counts
    if len(left):
        names = _names(2 * s + sign + 1, left, np.append(left[1:] + 1, np.int32(n)))
        order = np.argsort(names, kind="stable") if names.max() == len(names) - 1 else _ranks_by_doubling(names)
        sorted_left = left[order]
    else:
        sorted_left = left
    by = s[sorted_left]
    group = np.argsort(by, kind="stable")
    sorted_left, by = sorted_left[group], by[group]
    bounds = np.searchsorted(by, np.arange(len(heads) + 1))
    filled = [sorted_left[bounds[c] : bounds[c + 1]] for c in range(len(heads))]
    return _induce(s, sign, heads, tails, np.zeros(n, np.int32), filled)


def permuted_prefixes(data: np.ndarray, sa: np.ndarray, limit: int, heads: np.ndarray | None = None) -> np.ndarray:
    """For each position in text order, the bytes it shares with the suffix before it in the array, ``limit`` at most.

    If the bytes before a position and before its predecessor agree, its value is that of the position before it less one.
    Others, and the positions ``heads``, are compared eight bytes at a time, as far as positions up to the next head need.
    """
    n, most = len(data), limit
    limit += int(np.diff(np.append(heads, n)).max()) if heads is not None else n
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    padded = np.zeros(n + limit + 16, np.uint8)
    padded[:n] = data
    words = np.ndarray(n + limit + 8, "<u8", padded, strides=(1,))
    own = np.ones(n, bool)
    own[1:] = (before[1:] <= 0) | (data[:-1] != data[np.maximum(before[1:] - 1, 0)])
    if heads is not None:
        own[heads] = True
    value = np.zeros(n, np.int32)
    todo = np.flatnonzero(own & (before >= 0)).astype(np.int32)
    for have in range(0, limit, 8):
        x = words[todo + have] ^ words[before[todo] + have]
        differ = x != 0
        low = x[differ]
        value[todo[differ]] = np.int32(have) + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int32)
        todo = todo[~differ]
        if not len(todo):
            break
    value[todo] = limit
    room = n - np.maximum(np.arange(n, dtype=np.int32), before)
    np.minimum(value, room, out=value)
    at = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(own, at, 0))
    return np.clip(value[last] - (at - last), 0, most)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of set flags, and the places behind them."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def repeated(texts: list[bytes], lengths: tuple[int, ...] = (LENGTH,), spans: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, runs of windows that occur anywhere else in these texts: (text, first window, last window).

    With ``spans``, only windows that start that many bytes into a text, or before, count.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    if not len(data):
        return [(np.zeros(0, np.int64),) * 3 for _ in lengths]
    # windows over an end are not asked for, so that texts need nothing between them
    sa = suffix_array(data)
    heads = ends - sizes
    shared = permuted_prefixes(data, sa, max(lengths), heads[sizes > 0])[sa]
    room = np.repeat(ends, sizes)[sa] - sa
    starts = (np.arange(len(data)) <= np.repeat(heads + (np.array(spans, np.int64) if spans is not None else sizes), sizes))[sa]
    out = []
    for length in lengths:
        group = np.cumsum(shared < length)  # suffixes of one group share ``length`` bytes
        whole = starts & (room >= length)
        often = np.bincount(group[whole], minlength=int(group[-1]) + 1) > 1
        flags = np.zeros(len(data), bool)
        flags[sa[whole & often[group]]] = True
        first, behind = runs(flags)  # the last byte of a text starts no window, so a run stays in its text
        text = np.searchsorted(ends, first, "right")
        out.append((text, first - heads[text], behind - 1 - heads[text]))
    return out


# --- the distributed part ----------------------------------------------------

_STRETCH = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("lo", pa.int64()), ("off", pa.int32()), ("span", pa.int32()), ("size", pa.int32()), ("h", pa.int64()), ("ctx", pa.int64()), ("left", pa.int32()), ("right", pa.int32())])


def _find(length: int, passage: int, k: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            docs, keys = column(b, "doc_id"), column(b, "text_key")
            pieces = [(row, at, t[at : at + PIECE + length - 1]) for row, t in enumerate(as_bytes(b)) for at in range(0, max(len(t) - passage + 1, 0), PIECE)]
            group: list = []
            for p in [*pieces, None]:
                if group and (p is None or sum(len(g[2]) for g in group) + len(p[2]) > 2 * PIECE):
                    row, base, ends = np.array([g[0] for g in group]), np.array([g[1] for g in group]), np.cumsum([len(g[2]) for g in group])
                    x = stretches(np.frombuffer(b"".join(g[2] for g in group), np.uint8), ends, length, passage, k, PIECE)
                    lo = x["lo"]
                    own = np.searchsorted(ends, lo, "right")
                    start = np.append(0, ends[:-1])[own]
                    rows = pa.array(row[own])
                    small = [pa.array(c.astype(np.int32)) for c in (x["anchor"] - lo, x["hi"] - lo, x["size"])]
                    beside = [pa.array((x[c] >> np.uint64(32)).astype(np.uint32).view(np.int32), mask=x[c] == 0) for c in ("left", "right")]
                    yield pa.record_batch(
                        [docs.take(rows), keys.take(rows), pa.array(lo - start + base[own]), *small, pa.array(x["h"].view(np.int64)), pa.array(x["ctx"].view(np.int64)), *beside], schema=_STRETCH,
                    )
                    group = []
                if p is not None:
                    group.append(p)

    return work


#: Bytes that repeat: those of passages go from start to stop, those of strings of the full length from start to firm.
_MARK = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("firm", pa.int64())])
MARK = "doc_id long, text_key long, start long, stop long, firm long"


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the listed stretches of each document."""
    schema = pa.schema([("shard", pa.int64()), ("many", pa.bool_()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("lo", pa.int64()), ("span", pa.int64()), ("bytes", pa.binary())])
    for b in slices(batches):
        rows = []
        for i, (text, own) in enumerate(zip(as_bytes(b), column(b, "own").to_pylist(), strict=True)):
            rows += [(i, x["shard"], x["many"], x["lo"], x["span"], text[x["lo"] : x["lo"] + x["size"]]) for x in own]
        if rows:
            i, shard, many, lo, span, raw = map(list, zip(*rows, strict=True))
            i = pa.array(i)
            yield pa.record_batch([pa.array(shard, pa.int64()), pa.array(many), column(b, "doc_id").take(i), column(b, "text_key").take(i), pa.array(lo, pa.int64()), pa.array(span, pa.int64()), pa.array(raw, pa.binary())], schema=schema)


def _shards(length: int, passage: int):
    """Over stretches sorted by shard: marks of the windows that occur twice.  Whole shards are gathered to one suffix array."""

    def solve(rows: dict) -> pa.RecordBatch:
        doc, key, lo = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
        parts = []
        for n, (text, first, last) in zip((length, passage), repeated([r[1] for r in rows.values()], (length, passage), [r[0] for r in rows.values()]), strict=True):
            start = lo.to_numpy()[text] + first
            end = start + (last - first) + n
            text = pa.array(text)
            parts.append([doc.take(text), key.take(text), *map(pa.array, (start, start if n == length else end, end if n == length else start))])
        return pa.record_batch([pa.concat_arrays(c) for c in zip(*parts, strict=True)], schema=_MARK)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a stretch that several shards have is gathered once: a copy of itself is no repeat
        rows, size, last = {}, 0, None
        for b in batches:
            for shard, *place, span, raw in zip(*(column(b, c).to_pylist() for c in ("shard", "doc_id", "text_key", "lo", "span", "bytes")), strict=True):
                if size > SHARD_BYTES and shard != last:
                    yield solve(rows)
                    rows, size = {}, 0
                if tuple(place) not in rows:
                    rows[tuple(place)] = span, raw
                    size += len(raw)
                last = shard
        if rows:
            yield solve(rows)

    return work


def _windows(lengths: tuple[int, ...], tally: bool):
    """Hashed windows of stretches: each with its count in a batch, or each with its place."""
    counts = pa.schema([("shard", pa.int64()), ("length", pa.int32()), ("w", pa.int64()), ("n", pa.int64())])
    places = pa.schema([("shard", pa.int64()), ("length", pa.int32()), ("w", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "bytes"):
            raw, lo, span, shard = column(b, "bytes").to_pylist(), *(column(b, c).to_numpy() for c in ("lo", "span", "shard"))
            for at in range(0, len(raw), 256):
                part = raw[at : at + 256]
                sizes = np.array([len(x) for x in part])
                ends, hashes = np.cumsum(sizes), Hashes(np.frombuffer(b"".join(part), np.uint8))
                for length in lengths:
                    n = np.clip(sizes - length + 1, 0, span[at : at + 256] + 1)
                    own = np.repeat(np.arange(len(part)), n)
                    place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                    s = (ends - sizes)[own] + place
                    w = hashes.of(s, s + length).view(np.int64)
                    kind = np.full(len(w), length, np.int32)
                    if tally:
                        pairs, c = np.unique(np.stack([shard[at + own], w], 1), axis=0, return_counts=True)
                        yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(kind[: len(c)]), pa.array(pairs[:, 1].copy()), pa.array(c)], schema=counts)
                    else:
                        rows = pa.array(at + own)
                        yield pa.record_batch([pa.array(shard[at + own]), pa.array(kind), pa.array(w), column(b, "doc_id").take(rows), column(b, "text_key").take(rows), pa.array(lo[at + own] + place)], schema=places)

    return work


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("n_passages", pa.int64())])


def joined(owner: np.ndarray, start: np.ndarray, stop: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each owner (ascending numbers) that meet or overlap as one, in order; empty ones are passed over.  Places are under ``most``."""
    some = stop > start
    owner, start, stop = owner[some], start[some], stop[some]
    a, z = owner * (most + 2) + start, owner * (most + 2) + stop  # owners lie behind one another with a gap
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(z[order])
    first = np.ones(len(a), bool)
    first[1:] = a[1:] > reach[:-1]
    heads = np.flatnonzero(first)
    own, end = owner[order][heads], reach[np.append(heads[1:], len(a)) - 1] if len(a) else reach
    return own, a[heads] - own * (most + 2), end - own * (most + 2)


def _remove(words: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, marks = as_bytes(b), column(b, "marks")
            flat = marks.flatten()
            start, stop, firm = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            owner = np.repeat(np.arange(len(texts)), marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            most = max(map(len, texts))
            kept: list[list[bytes]] = [[] for _ in texts]
            at, spans, passages = [0] * len(texts), [0] * len(texts), [0] * len(texts)
            for i, a, z in zip(*(c.tolist() for c in joined(owner, start, firm, most)), strict=True):
                kept[i].append(texts[i][at[i] : a])
                at[i] = z
                spans[i] += 1
            for i, a, z in zip(*(c.tolist() for c in joined(owner, start, np.maximum(stop, firm), most)), strict=True):
                passages[i] += len(texts[i][a:z].split()) > words
            left = [b"".join([*k, t[z:]]) for k, t, z in zip(kept, texts, at, strict=True)]
            sizes = [(len(t), len(t) - len(x)) for t, x in zip(texts, left, strict=True)]
            digests = [hashlib.sha256(x).hexdigest() for x in left]
            cols = [[n for n, _ in sizes], [n for _, n in sizes], spans, digests, left, passages]
            yield pa.record_batch([column(b, "doc_id"), *(pa.array(c, _RESULT.field(i + 1).type) for i, c in enumerate(cols))], schema=_RESULT)

    return work


def suffix_dedup(docs: DataFrame, length: int = LENGTH, k: int = K, most: int = SHARD_STRETCHES, passage: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """Remove every byte of each ``length``-byte string that also starts elsewhere.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, n_passages), a
    row per row of ``docs``.  Texts are UTF-8 bytes, null being empty; strings never
    cross documents; overlapping occurrences in one document count; all is judged
    on the input; other columns of ``docs`` are not read.  ``kept`` is binary, as a
    cut may fall into a character.  ``n_passages`` counts the maximal runs of bytes
    of ``passage``-byte strings that also start elsewhere which have more than
    ``words`` words; they may be too short to be removed.  ``passage`` is from
    ``k`` + 1 to ``length``.
    """
    if not k < passage <= length:
        raise ValueError("k < passage <= length")
    kind = ["h", "ctx", "off", "span", "size"]
    small_batches(docs.sparkSession)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", document_key()[1])
    fields = "doc_id long, text_key long, lo long, off int, span int, size int, h long, ctx long, left int, right int"
    found = settle(base.mapInArrow(_find(length, passage, k), fields), "stretches")
    twice = settle(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors")
    found = settle(found.join(twice, "h"), "shared-stretches")
    kinds = found.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "lo")).alias("at"), F.any_value("left").alias("left"), F.any_value("right").alias("right"))
    kinds = settle(kinds, "kinds")
    copies = found.join(settle(kinds.where("n > 1").select(*kind), "copies"), kind)
    firm = F.col("lo") + F.when(F.col("size") >= length, F.col("size")).otherwise(F.lit(0))
    marks = copies.select("doc_id", "text_key", F.col("lo").alias("start"), (F.col("lo") + F.col("span") + passage).alias("stop"), firm.alias("firm"))
    sides = F.filter(F.array(F.struct(F.lit(0).alias("of"), F.col("left").alias("key")), F.struct(F.lit(1).alias("of"), F.col("right").alias("key"))), lambda x: x["key"].isNotNull())
    sides = kinds.select("at", "span", "size", "h", F.explode(sides).alias("side")).withColumn("shard", F.xxhash64("h", "side")).drop("h", "side")
    groups = settle(sides.groupBy("shard").agg(F.count("*").alias("c")).where("c > 1"), "shards")
    reps = sides.join(groups, "shard").select("at.*", "span", "size", "shard", (F.col("c") > most).alias("many"))
    reps = reps.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "span", "size", "shard", "many")).alias("own"))
    # a row that repeats a document brings its stretches again, but then they were copies all along
    cut = key_join(base, reps, "inner").mapInArrow(_cut, "shard long, many boolean, doc_id long, text_key long, lo long, span long, bytes binary")
    cut = settle(cut, "cut")
    few = cut.where("not many").repartition("shard").sortWithinPartitions("shard", "doc_id", "text_key", "lo")
    marks = marks.unionByName(few.mapInArrow(_shards(length, passage), MARK))
    if not groups.where(F.col("c") > most).isEmpty():
        crowd, both = cut.where("many").drop("many"), (length, passage)
        often = crowd.mapInArrow(_windows(both, True), "shard long, length int, w long, n long").groupBy("shard", "length", "w").agg(F.sum("n").alias("n"))
        places = crowd.mapInArrow(_windows(both, False), "shard long, length int, w long, doc_id long, text_key long, start long")
        hit = places.join(settle(often.where("n > 1").drop("n"), "often"), ["shard", "length", "w"])
        is_firm, end = F.col("length") == length, F.col("start") + F.col("length")
        hit = hit.select("doc_id", "text_key", "start", F.when(is_firm, F.col("start")).otherwise(end).alias("stop"), F.when(is_firm, end).otherwise(F.col("start")).alias("firm"))
        marks = marks.unionByName(hit)
    # a set, as rows that repeat a document bring the same marks
    per = marks.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop", "firm")).alias("marks"))
    out = key_join(base, per).select("doc_id", "text", "marks")
    return out.mapInArrow(_remove(words), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_passages long")

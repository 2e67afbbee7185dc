"""Benchmark decontamination with a generalised suffix automaton over words.

Test items are normalised to words and put into one automaton per block of
items; documents stream through it, and the longest match that ends at each
word tells whether the word closes an occurrence of a window.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canopy.functions.storage import settle
from canopy.llm.common import as_bytes, column, held, slices, small_batches

#: Words of items in one automaton; larger sets of items take several, one pass over the documents each.
BLOCK_WORDS = 200_000
WINDOW = 10

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return text.translate(_FOLD).split()


class ItemAutomaton:
    """Generalised suffix automaton of item words, with the items of each window.

    State 0 is the root.  ``anchor[v]`` is the state on the suffix path of v
    that holds the string of ``window`` words; ``shorts[v]`` lists the whole
    items of fewer words that are suffixes of v's longest string.
    """

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            if ids:
                coded.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        n = len(self.next)
        self.anchor = [-1] * n
        self.shorts: list[tuple] = [()] * n
        order = sorted(range(n), key=self.length.__getitem__)
        for v in order[1:]:
            up = self.link[v]
            if self.length[v] >= window:
                self.anchor[v] = v if self.length[up] < window else self.anchor[up]
        names: dict[int, set[str]] = {}
        own: dict[int, dict[int, set[str]]] = {}
        for name, ids in coded:
            v = 0
            for i, c in enumerate(ids, 1):
                v = self.next[v][c]
                if i >= window:
                    names.setdefault(self.anchor[v], set()).add(name)
            if len(ids) < window:
                own.setdefault(v, {}).setdefault(len(ids), set()).add(name)
        self.items = {v: tuple(s) for v, s in names.items()}
        for v in order[1:]:
            mine = tuple((size, tuple(s)) for size, s in own.get(v, {}).items())
            self.shorts[v] = mine + self.shorts[self.link[v]]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[bytearray | None, set[str]]:
        """Flags of the words inside occurrences (None if none), and the items that occur."""
        nxt, link, length, shorts, window = self.next, self.link, self.length, self.shorts, self.window
        hit, found = None, set()
        v = m = 0
        for i, c in enumerate(map(self.vocab.get, words)):
            if c is None:
                v = m = 0
                continue
            to = nxt[v].get(c)
            if to is None:
                while to is None and v:
                    v = link[v]
                    to = nxt[v].get(c)
                m = length[v]
                if to is None:
                    continue
            v = to
            m += 1
            if m >= window:
                hit = hit or bytearray(len(words))
                hit[i + 1 - window : i + 1] = b"\x01" * window
                # a longer string of the state than the one read has the same suffix of `window` words
                found.update(self.items[self.anchor[v]])
            if shorts[v]:
                for size, names in shorts[v]:
                    if size <= m:
                        hit = hit or bytearray(len(words))
                        hit[i + 1 - size : i + 1] = b"\x01" * size
                        found.update(names)
        return hit, found


def blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of bounded size, streamed through the driver."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    for name, text in rows.toLocalIterator():
        raw = text.encode()
        block.append((name, raw))
        size += len(words_of(raw))
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _scan(shared, window):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = held(("op6", shared.value, window), lambda: ItemAutomaton(pickle.loads(shared.value), window))
        for b in slices(batches):
            hits, items = [], []
            before = zip(column(b, "hit").to_pylist(), column(b, "items").to_pylist(), strict=True)
            for text, (old, names) in zip(as_bytes(b), before, strict=True):
                hit, found = auto.scan(words_of(text))
                if hit and old:
                    hit = (int.from_bytes(hit, "big") | int.from_bytes(old, "big")).to_bytes(len(old), "big")
                hits.append(bytes(hit) if hit else old)
                items.append(sorted(found.union(names or ()) - {None}) or None)
            found = {"hit": pa.array(hits, pa.binary()), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([found.get(n, c) for n, c in zip(b.schema.names, b.columns, strict=True)], names=b.schema.names)

    return work


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, hit, items) and the columns ``keep``, a row per row of ``docs``.

    ``hit`` has a byte per word, 1 inside an occurrence of a window, or is null
    if there is none; ``items`` are the ids of the items that occur.  A window is
    ``window`` consecutive words of an item, or all words of a shorter item.  Null
    texts have no words.  An item without an id is looked for like any other, but
    it is not listed; items that share an id count once.  One block of items is
    held at a time; each further block is one more pass.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.select("doc_id", "text", F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items"), *keep)
    for n, block in enumerate(blocks(items, block_words)):
        out = settle(out, "leaks") if n else out
        shared = spark.sparkContext.broadcast(pickle.dumps(block))
        out = out.mapInArrow(_scan(shared, window), out.schema)
    return out


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("clean_text", pa.string())])


def without_hits(text: bytes, hit: bytes) -> bytes:
    """The text without each run of hit words, from the first to the last."""
    out, at, i = [], 0, 0
    spans = [m.span() for m in _WORD.finditer(text)]
    while (i := hit.find(1, i)) >= 0:
        end = hit.find(0, i)
        end = len(hit) if end < 0 else end
        out.append(text[at : spans[i][0]])
        at = spans[end - 1][1]
        i = end
    return b"".join([*out, text[at:]])


def _report(max_coverage, keep):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text, hit, items, raw in zip(as_bytes(b), column(b, "hit").to_pylist(), column(b, "items").to_pylist(), column(b, "text").is_null().to_pylist(), strict=True):
                n, n_hit = len(words_of(text)), hit.count(1) if hit else 0
                over = n_hit and max_coverage is not None and n_hit > max_coverage * n
                clean = None if over or raw else without_hits(text, hit) if hit else text
                rows.append((n, n_hit, len(items or ()), hashlib.sha256(",".join(items or ()).encode()).hexdigest(), n_hit > 0, clean.decode() if clean is not None else None))
            cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
            made = [pa.array(c, _RESULT.field(i + 1).type) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *made, *(column(b, k) for k in keep)], names=[*_RESULT.names, *keep])

    return work


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float | None = 0.5, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Report and remove benchmark passages.

    Returns (doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    clean_text) and the columns ``keep``, a row per row of ``docs``.  ``clean_text``
    lacks the spans of hit words; it is null if the text is null or if more than
    ``max_coverage`` of its words are hit, in which case the document should go.
    Columns of ``keep`` that have the name of a result are passed over.
    """
    keep = tuple(k for k in keep if k not in _RESULT.names and k != "text")
    made = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, clean_text string"
    schema = StructType([*StructType.fromDDL(made).fields, *(docs.schema[k] for k in keep)])
    return find_leaks(docs, items, window, block_words, keep).mapInArrow(_report(max_coverage, keep), schema)

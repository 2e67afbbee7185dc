"""Token ids as binary segments: canonical Huffman codes with block checkpoints.

Documents are encoded in ascending order of doc_id.  A length-limited canonical
code is built from the global counts of ids.  Ids are written in segments, each
a run of documents: a header, a table of documents, the bit offset of every
block of ids, and the code bits.  Blocks decode independently of one another by
table look-up; all blocks of a segment are decoded side by side.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.storage import settle
from canopy.llm.chunk_table import PAD, ChunkTable
from canopy.llm.common import column, held, slices, small_batches

#: Longest code in bits; the decoding table has 2**LIMIT entries.
LIMIT = 18
#: Ids between two checkpoints.
BLOCK = 256
MAGIC = b"CNPYSEG2"
#: Encoded chunks that a worker remembers.
CACHE = 1_000_000
#: Chunks that are encoded as one text.
JOINED = 50
_WORD, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_WORD[list(map(ord, string.ascii_letters + string.digits))] = True
_MARK[list(map(ord, string.punctuation.replace("'", "")))] = True
_BLANKS = b" \t\n\x0b\x0c\r"
#: First bytes of white space beyond ASCII, and the whole of it: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
_WIDE_LEAD = (0xC2, 0xE1, 0xE2, 0xE3)
_WIDE_BLANK = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def text_bytes(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of a column of strings, joined, and where each ends; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    return (raw.slice(int(bounds[0]), int(bounds[-1] - bounds[0])).to_pybytes() if raw else b""), bounds[1:] - bounds[0]


class ChunkEncoder:
    """Byte-level BPE through the tokenizers library, with a bounded memory of chunks.

    A text may be cut where the pre-tokenizer never joins: before an ASCII blank
    that follows something else, and between an ASCII letter or digit and the
    punctuation after it (but for the apostrophe of a contraction).  Texts with other white space or
    with the string of a special token are encoded whole.  ``specials_as_text``
    is the library's setting: False, its default, gives such strings their
    special ids; True takes them for plain text.
    """

    def __init__(self, tokenizer_json: bytes, end_id: int = 0, specials_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.tokenizer.model._resize_cache(0)  # the library would remember the same chunks once more
        self.end_id = end_id
        vocab = self.tokenizer.get_vocab()
        self.size = max(max(vocab.values()), end_id) + 1
        self.n_bytes = np.zeros(self.size, np.int64)
        for token, i in vocab.items():  # a character of a byte-level token stands for a byte
            self.n_bytes[i] = len(token)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.table = ChunkTable(self._learn, CACHE, self.dtype)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks that start with a blank and end without are encoded many at a time, then cut apart by their bytes."""
        joined = [i for i, c in enumerate(new) if c[0] in _BLANKS and c[-1] not in _BLANKS]
        alone = sorted(set(range(len(new))).difference(joined))
        texts = [b"".join([new[i] for i in joined[k : k + JOINED]]).decode() for k in range(0, len(joined), JOINED)]
        texts += [new[i].decode() for i in alone]
        ids = list(chain.from_iterable([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]))
        flat = np.array(ids, self.dtype)
        order = np.array(joined + alone, np.int64)
        size = np.fromiter(map(len, new), np.int64, len(new))[order]
        stops = np.searchsorted(np.cumsum(self.n_bytes[flat]), np.cumsum(size), "right")
        starts, sizes = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        starts[order], sizes[order] = np.append(0, stops[:-1]), np.diff(stops, prepend=0)
        return flat, starts, sizes

    def _odd(self, data: np.ndarray, raw: bytes, ends: np.ndarray) -> set[int]:
        """Texts that must not be cut."""
        out: set[int] = set()
        lead = np.zeros(256, bool)
        lead[list(_WIDE_LEAD)] = True
        at = np.flatnonzero(lead[data])
        for i in np.unique(np.searchsorted(ends, at, "right")).tolist():
            start = int(ends[i - 1]) if i else 0
            if _WIDE_BLANK.search(raw[start : int(ends[i])].decode()):
                out.add(i)
        for special in self.specials:
            here = raw.find(special)
            while here >= 0:
                i = int(np.searchsorted(ends, here, "right"))
                if here + len(special) <= ends[i]:
                    out.add(i)
                here = raw.find(special, here + 1)
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, each with the end id behind it, and how many each has."""
        raw, ends = text_bytes(texts)
        padded = np.zeros(len(raw) + PAD, np.uint8)
        padded[: len(raw)] = np.frombuffer(raw, np.uint8)
        data = padded[: len(raw)]
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut[1:] |= _MARK[data[1:]] & _WORD[data[:-1]]
        sizes = np.diff(ends, prepend=0)
        cut[(ends - sizes)[sizes > 0]] = True
        at = np.flatnonzero(cut)
        index = self.table.index(padded, raw, at, np.diff(at, append=len(raw)))
        many = self.table.sizes[index]
        owner = np.searchsorted(ends, at, "right")
        n = np.bincount(owner, many, len(ends)).astype(np.int64) + 1
        out, last = np.empty(int(n.sum()), self.dtype), np.cumsum(n) - 1
        body = np.ones(len(out), bool)
        body[last] = False
        out[body], out[last] = self.table.runs(index), self.end_id
        odd = self._odd(data, raw, ends)
        if odd:
            parts = np.split(out, last[:-1] + 1)
            for i in odd:
                own = raw[int(ends[i] - sizes[i]) : int(ends[i])].decode()
                parts[i] = np.array([*self.whole(own), self.end_id], self.dtype)
            out, n = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return out, n

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        ids, n = self.encode_column(pa.array(texts, pa.large_string()))
        return np.split(ids.astype(np.uint32), np.cumsum(n)[:-1])


def _encoder(tokenizer_json: bytes, end_id: int, specials_as_text: bool) -> ChunkEncoder:
    """One encoder for all tasks of a worker."""
    return held(("op9", tokenizer_json, end_id, specials_as_text), lambda: ChunkEncoder(tokenizer_json, end_id, specials_as_text))


def _width(raw: bytes, n: int) -> str:
    """Type of ``n`` ids that an intermediate table holds in two or four bytes each."""
    return "<u2" if len(raw) == 2 * n else "<u4"


def _encode(tokenizer, end_id: int, specials_as_text: bool):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.large_binary())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer.value, end_id, specials_as_text)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        for b in slices(batches):
            ids, sizes = encoder.encode_column(column(b, "text"))
            starts = start + np.cumsum(sizes) - sizes
            bounds = np.append(0, np.cumsum(sizes)) * ids.itemsize
            raw = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
            yield pa.record_batch(
                [pa.array(np.full(len(sizes), part, np.int32)), pa.array(np.arange(seq, seq + len(sizes))), column(b, "doc_id"), pa.array(starts), pa.array(sizes), raw], schema=schema,
            )
            seq += len(sizes)
            start += int(sizes.sum())

    return work


def _tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for b in batches:
        for raw, size in zip(column(b, "ids").to_pylist(), column(b, "n_tokens").to_pylist(), strict=True):
            n = np.bincount(np.frombuffer(raw, _width(raw, size)), minlength=len(total))
            n[: len(total)] += total
            total = n
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["id", "n"])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge), 0 for unused symbols."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("too many symbols for the length limit")
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.float64)
    is_leaf, merged = [], weights
    is_leaf.append(np.ones(len(order), bool))
    for _ in range(limit - 1):
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        is_leaf.append(rank < len(weights))
    take, lengths = 2 * len(order) - 2, np.zeros(len(order), np.uint8)
    for leaf in reversed(is_leaf):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


class Code:
    """The canonical code of given lengths: shorter codes first, then smaller ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.checksum = zlib.crc32(self.lengths.tobytes())
        self.bits = max(1, int(self.lengths.max(initial=0)))
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        spans = np.left_shift(1, self.bits - self.lengths[order].astype(np.int64))
        firsts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[order] = (firsts >> (self.bits - self.lengths[order].astype(np.int64))).astype(np.uint64)
        self.symbols = np.zeros(1 << self.bits, np.uint32)
        filled = int(spans.sum())
        self.symbols[:filled] = np.repeat(order.astype(np.uint32), spans)

    def pack(self, ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, bytes]:
        """Bit offsets of the blocks, and the bits in big-endian words of 32."""
        size = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(size)
        at = ends - size
        words = int(ends[-1]) // 32 + 2 if len(ids) else 2
        out = np.zeros(words, np.uint32)
        if len(ids):
            value = self.codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
            word = at >> 5
            firsts = np.flatnonzero(np.diff(word, prepend=-1))
            value = np.bitwise_or.reduceat(value, firsts)
            word = word[firsts]
            out[word] |= (value >> np.uint64(32)).astype(np.uint32)
            out[word + 1] |= (value & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return at[::block].copy(), out.astype(">u4").tobytes()

    def unpack(self, offsets: np.ndarray, bits: bytes, n: int, block: int = BLOCK) -> np.ndarray:
        """All blocks side by side, one id of each at a time."""
        words = np.frombuffer(bits, ">u4").astype(np.uint64)
        window = (words[:-1] << np.uint64(32)) | words[1:]
        out = np.zeros((block, len(offsets)), np.uint32)
        pos = np.asarray(offsets, np.int64).copy()
        sizes = self.lengths.astype(np.int64)
        last = n - (len(offsets) - 1) * block if len(offsets) else 0
        base, mask = 64 - self.bits, (1 << self.bits) - 1
        for i in range(block if len(offsets) > 1 else last):
            if i == last:  # the last block is over
                pos = pos[:-1]
            code = (window[pos >> 5] >> (base - (pos & 31)).astype(np.uint64)).astype(np.int64) & mask
            got = self.symbols[code]
            out[i, : len(pos)] = got
            pos = pos + sizes[got]
        return out.T.reshape(-1)[:n]


_HEAD = struct.Struct("<8sIIQQQ")
#: The row of a table of segments that holds the code: its ``first_token``, and the start of its bytes.
CODE_ROW, CODE_MAGIC = -1, b"CNPYCODE2"


def write_code(lengths: np.ndarray) -> bytes:
    """The code lengths of all ids, for the row of the code."""
    return CODE_MAGIC + zlib.compress(np.asarray(lengths, np.uint8).tobytes())


def read_code(blob: bytes) -> np.ndarray:
    if not blob.startswith(CODE_MAGIC):
        raise ValueError("not a code of token ids")
    return np.frombuffer(zlib.decompress(blob[len(CODE_MAGIC) :]), np.uint8)


def write_segment(code: Code, doc_ids: np.ndarray, has_id: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Header (magic, checksum of the code, ids a block, documents, ids, blocks), four columns of documents, checkpoints, bits."""
    offsets, bits = code.pack(ids, block)
    head = _HEAD.pack(MAGIC, code.checksum, block, len(doc_ids), len(ids), len(offsets))
    return b"".join([head, *(np.asarray(x, "<i8").tobytes() for x in (doc_ids, has_id, starts, sizes, offsets)), bits])


def read_segment(code: Code, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, has_id, starts, sizes, ids) of a segment."""
    magic, checksum, block, docs, n, blocks = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    if checksum != code.checksum:
        raise ValueError("the segment was written with another code")
    at, cols = _HEAD.size, []
    for m in (docs, docs, docs, docs, blocks):
        cols.append(np.frombuffer(blob, "<i8", m, at))
        at += 8 * m
    return (*cols[:4], code.unpack(cols[4], blob[at:], n, block))


def _segments(lengths, offsets):
    schema = pa.schema([("first_token", pa.int64()), ("segment", pa.large_binary())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths.value, np.uint8))
        for b in slices(batches, "ids"):
            part, seq = (column(b, c).to_numpy() for c in ("part", "seq"))
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(seq) != 1)) + 1
            raw = column(b, "ids").to_pylist()
            docs = column(b, "doc_id")
            has, doc_ids = docs.is_valid().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
            starts = column(b, "local_start").to_numpy() + np.array([offsets[p] for p in part.tolist()], np.int64)
            sizes = column(b, "n_tokens").to_numpy()
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                own = b"".join(raw[s:e])
                ids = np.frombuffer(own, _width(own, int(sizes[s:e].sum())))
                blob = write_segment(code, doc_ids[s:e], has[s:e], starts[s:e], sizes[s:e], ids)
                yield pa.record_batch([pa.array([int(starts[s])]), pa.array([blob], pa.large_binary())], schema=schema)

    return work


def write_tokens(docs: DataFrame, tokenizer_json: bytes, end_id: int = 0, limit: int = LIMIT, specials_as_text: bool = False, path: str | None = None) -> DataFrame:
    """Encode and write; returns the table of segments (first_token, segment), which is all that ``read_tokens`` needs.

    The table is written to ``path``, or else to the shared folder; ``first_token``
    puts segments in order, and the row with CODE_ROW there holds the code.  Null
    doc_ids come first, and rows of one doc_id follow a hash of their text.  A null
    text has the end id only.  Strings of special tokens in a text become their
    special ids, as the library has it by default; ``specials_as_text`` takes them
    for plain text.  The driver holds one number per partition and one per id of
    the vocabulary.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    coded = settle(ranged.mapInArrow(_encode(shared, end_id, specials_as_text), "part int, seq long, doc_id long, local_start long, n_tokens long, ids binary"), "ids")
    offsets, total = {}, 0
    for part, n in sorted(map(tuple, coded.groupBy("part").agg(F.sum("n_tokens")).collect())):
        offsets[part], total = total, total + n
    tally = coded.select("ids", "n_tokens").mapInArrow(_tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in tally), default=0) + 1, np.int64)
    for r in tally:
        counts[r.id] = r.n
    lengths = code_lengths(counts, limit)
    schema = "first_token long, segment binary"
    segments = coded.mapInArrow(_segments(spark.sparkContext.broadcast(lengths.tobytes()), offsets), schema)
    segments = segments.unionByName(spark.createDataFrame([(CODE_ROW, write_code(lengths))], schema))
    if path is None:
        return settle(segments, "segments")
    segments.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _read(lengths):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.large_binary())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths.value, np.uint8))
        for b in batches:
            for blob in column(b, "segment").to_pylist():
                doc_ids, has, starts, sizes, ids = read_segment(code, blob)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes) * 4
                parts = [raw[e - 4 * n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(doc_ids, mask=has == 0), pa.array(starts), pa.array(sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                     pa.array([bytes(p) for p in parts], pa.large_binary())], schema=schema,
                )

    return work


def read_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document, from a table of segments alone.

    ``ids`` are little-endian words of 32 bits.
    """
    spark = segments.sparkSession
    small_batches(spark)
    code = segments.where(F.col("first_token") == CODE_ROW).first()
    if code is None:
        raise ValueError("the table has no code")
    shared = spark.sparkContext.broadcast(read_code(bytes(code.segment)).tobytes())
    rows = segments.where(F.col("first_token") != CODE_ROW).select("segment")
    return rows.mapInArrow(_read(shared), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")

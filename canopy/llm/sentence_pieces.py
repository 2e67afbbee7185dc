"""SentencePiece encoding with n-best segmentations, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canopy.llm.common import Memo, column, give_back, held, slices, small_batches, with_fields
from canopy.llm.pieces import Pieces

#: Segmentations of a text that are scored.
NBEST = 4
#: Cells that a worker remembers.
CACHE = 200_000


def smallest_choices(gaps: list[list[float]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The ``n`` smallest sums of one entry of each list, and which entries other than the first they take; lists are sorted and start with 0.

    Best-first over the lists in order of their second entries: a state may
    raise the last list it has touched, or go over to a later one.
    """
    order = sorted((i for i, g in enumerate(gaps) if len(g) > 1), key=lambda i: gaps[i][1])
    lists = [gaps[i] for i in order]
    out: list[tuple[float, dict[int, int]]] = [(0.0, {})]
    agenda: list = [(lists[0][1], 0, 1, ())] if lists else []
    while agenda and len(out) < n:
        total, i, j, before = heapq.heappop(agenda)
        out.append((total, {order[a]: b for a, b in (*before, (i, j))}))
        own = lists[i]
        if j + 1 < len(own):
            heapq.heappush(agenda, (total - own[j] + own[j + 1], i, j + 1, before))
        if i + 1 < len(lists):
            heapq.heappush(agenda, (total + lists[i + 1][1], i + 1, 1, (*before, (i, j))))
            if j == 1:
                heapq.heappush(agenda, (total - own[1] + lists[i + 1][1], i + 1, 1, before))
    return out


def smallest_sums(gaps: list[list[float]], n: int) -> list[float]:
    """The sums alone."""
    return [total for total, _ in smallest_choices(gaps, n)]


class Encoder:
    """Encodes many texts, remembering the segmentations of cells.

    The best and the second-best score of a cell come from one forward pass.  The
    n best segmentations of a text differ from its best one in the cells with
    the smallest loss only, so just those cells are searched backwards.
    """

    def __init__(self, pieces: Pieces, nbest: int = NBEST, whole: bool = False):
        self.pieces, self.nbest, self.whole = pieces, nbest, whole
        self.memo = Memo(pieces.best_two_all, CACHE, np.int32, 2)
        self.found: dict[str, tuple[list[float], list[np.ndarray]]] = {}

    def _searched(self, cell: str) -> tuple[list[float], list[np.ndarray]]:
        """How much worse each of the n best segmentations of a cell is than the best, and their ids, from the backward search."""
        got = self.found.get(cell)
        if got is None:
            if len(self.found) > CACHE // 4:
                self.found.clear()
            found = self.pieces.nbest(cell, self.nbest)
            # ids take much more memory than losses, so they are kept only if they are asked for
            got = self.found[cell] = [found[0][0] - s for s, _ in found], [np.array(ids, np.int32) for _, ids in found] if self.whole else []
        return got

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, list[float]]]:
        """(ids of the best segmentation, scores of the n best) of each text."""
        return [(ids, scores) for ids, scores, _ in self.segment_all(texts)]

    def segment_all(self, texts: list[str]) -> list[tuple[np.ndarray, list[float], list[np.ndarray]]]:
        """(ids of the best segmentation, scores of the n best, ids of the n best) of each text; of the last the best alone unless ``whole``."""
        cells = [self.pieces.cells(t) for t in texts]
        index = self.memo.index(cells)
        ids, (best, loss), k = self.memo.runs(index), self.memo.extra[:, index], self.nbest - 1
        stops = np.append(0, np.cumsum(self.memo.sizes[index]))
        out, at = [], 0
        for own in cells:
            to = at + len(own)
            # sums of n entries touch only the lists with the n - 1 smallest second entries
            near = np.argpartition(loss[at:to], k - 1)[:k].tolist() if len(own) > k > 0 else list(range(min(len(own), k)))
            top, searched = float(best[at:to].sum()), [self._searched(own[i]) for i in near]
            choices = smallest_choices([x[0] for x in searched], self.nbest)
            whole = ids[stops[at] : stops[to]]
            ways = [whole]
            for _, other in choices[1:] if self.whole else ():
                parts, have = [], stops[at]
                for i in sorted(other, key=near.__getitem__):
                    cell = at + near[i]
                    parts += [ids[have : stops[cell]], searched[i][1][other[i]]]
                    have = stops[cell + 1]
                ways.append(np.concatenate([*parts, ids[have : stops[to]]]))
            out.append((whole, [top - total for total, _ in choices], ways))
            at = to
        return out


def _encoder(model: bytes, nbest: int, whole: bool = False) -> Encoder:
    return held(("op4", model, nbest, whole), lambda: Encoder(Pieces(model), nbest, whole))


def _nested(lists: list[list[np.ndarray]]) -> pa.ListArray:
    """Lists of arrays of ids, with no Python object for an id."""
    arrays = [np.zeros(0, np.int32), *(x for own in lists for x in own)]
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in arrays]).astype(np.int32)), pa.array(np.concatenate(arrays)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(own) for own in lists])).astype(np.int32)), inner)


def encode(docs: DataFrame, model: bytes, nbest: int = NBEST, whole: bool = False) -> DataFrame:
    """``docs`` (any columns, among them ``text``) with the pieces of each text.

    Adds ids (of the best segmentation), n_pieces, ids_crc32 (of the ids as
    little-endian words of 32 bits), nbest_scores (of the ``nbest`` best
    segmentations, best first; fewer if the text has fewer; with ``whole`` there are
    nbest_ids, their ids, and nbest_crc32 of each too), decoded_sha256 (of
    the text decoded from the ids) and lossless (whether that is the text).
    A null or empty text has no pieces.  The result columns replace columns of
    the same name.  A space mark (U+2581) in a text decodes to a space.
    """
    new = ("ids", "n_pieces", "ids_crc32", "nbest_scores", "decoded_sha256", "lossless", *(("nbest_ids", "nbest_crc32") if whole else ()))
    docs = docs.select(*[c for c in docs.columns if c not in new])
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = "ids array<int>, n_pieces long, ids_crc32 long, nbest_scores array<double>, decoded_sha256 string, lossless boolean"
    added += ", nbest_ids array<array<int>>, nbest_crc32 array<long>" if whole else ""
    schema = with_fields(docs.schema, added)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, nbest, whole)
        for b in slices(batches):
            texts = [x or "" for x in column(b, "text").to_pylist()]
            got = encoder.segment_all(texts)
            decoded = [encoder.pieces.decode(ids.tolist()) for ids, _, _ in got]
            sizes = np.fromiter((len(ids) for ids, _, _ in got), np.int64, len(got))
            flat = np.concatenate([ids for ids, _, _ in got])
            sums = [[zlib.crc32(w.astype("<u4")) for w in ways] for _, _, ways in got]
            cols = [
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat)),
                pa.array(sizes), pa.array([own[0] for own in sums], pa.int64()),
                pa.array([s for _, s, _ in got], pa.list_(pa.float64())), pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                pa.array([x == t.encode() for x, t in zip(decoded, texts, strict=True)]),
            ]
            if whole:
                cols += [_nested([ways for _, _, ways in got]), pa.array(sums, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *new])
        # the worker may wait for long, and what the last slice has left counts against its executor
        texts = got = decoded = flat = cols = b = None
        give_back()

    return docs.mapInArrow(work, schema)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """A table with a column ``ids`` and the column ``decoded`` that they spell; invalid UTF-8 becomes U+FFFD."""
    encoded = encoded.select(*[c for c in encoded.columns if c != "decoded"])
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _encoder(shared.value, 1).pieces
        for b in slices(batches, "ids"):
            texts = [pieces.decode(x or []).decode("utf-8", "replace") for x in column(b, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(work, with_fields(encoded.schema, "decoded string"))

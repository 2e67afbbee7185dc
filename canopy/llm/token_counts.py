"""Token counts by a Viterbi pass that carries scores and counts only."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canopy.llm.common import Memo, column, held, slices, small_batches
from canopy.llm.pieces import Pieces

#: Cells that a worker remembers.
CACHE = 400_000


class Counter:
    """Counts the pieces of many texts, remembering the counts of cells."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.memo = Memo(self._learn, CACHE, np.int8, 2)

    def _learn(self, new: list[str]) -> tuple[list, np.ndarray]:
        return [()] * len(new), np.array(list(map(self.pieces.count, new)), np.float64).T

    def count_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, score) of the best segmentation of each text."""
        cells = [self.pieces.cells(t) for t in texts]
        index = self.memo.index(cells)
        many = np.array([len(c) for c in cells], np.int64)
        got = np.zeros((2, len(texts)))
        if len(index):  # each text is summed by itself, so that its score does not depend on its neighbours
            got[:, many > 0] = np.add.reduceat(self.memo.extra[:, index], (np.cumsum(many) - many)[many > 0], axis=1)
        return got[0].astype(np.int64), got[1]


def _counter(model: bytes) -> Counter:
    return held(("op10", model), lambda: Counter(Pieces(model)))


def token_counts(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens, score), a row per row of ``docs``.

    ``model`` is a SentencePiece file whose scores are taken as those of a
    unigram vocabulary and added in the order of the text (exactly, if they are
    whole numbers as in byte-pair files).  Of equal scores the segmentation that
    the tokenizer meets first counts.  Characters outside the vocabulary count
    as their bytes if it has byte pieces.  A null or empty text has none.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for b in slices(batches):
            counts, scores = counter.count_all([x or "" for x in column(b, "text").to_pylist()])
            yield pa.record_batch([column(b, "doc_id"), pa.array(counts), pa.array(scores)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, score double")

"""Helpers that several document operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Most bytes of text that one worker holds as Python objects at a time.
SLICE_BYTES = 2 << 20
#: Characters of all strings of a memo, for each string of its limit.
LETTERS = 16
#: New strings that a memo learns at a time.
LEARN = 16_384
#: Bytes of one Arrow batch between Spark and a worker.
BATCH_BYTES = 4 << 20
_held: dict = {}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a bound of its own: rows hold whole texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def held(key: tuple, build: Callable[[], object]):
    """What ``build`` gives, kept for later tasks of the worker until it needs another model."""
    if key not in _held:
        forget()
        _held[key] = build()
    return _held[key]


def forget() -> None:
    """Drop the model that earlier tasks of the worker have kept, and give freed memory back to the system: it counts against the executor."""
    if _held:
        _held.clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Give freed memory back to the system, and keep the model."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def document_key() -> list[Column]:
    """Columns that identify a document: its id and a hash of its text.

    Two rows that share both are copies of one another, so what holds for one
    holds for the other; rows that share an id alone stay apart.
    """
    return [F.col("doc_id"), F.xxhash64("text").alias("text_key")]


def key_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on (doc_id, text_key), where a null id equals a null id."""
    r = right.withColumnRenamed("doc_id", "_r_id").withColumnRenamed("text_key", "_r_key")
    on = F.col("text_key").eqNullSafe(F.col("_r_key")) & F.col("doc_id").eqNullSafe(F.col("_r_id"))
    return left.join(r, on, how).drop("_r_id", "_r_key")


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about SLICE_BYTES of text at most."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * SLICE_BYTES / max(col.nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A schema with further fields behind its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


class _Places(dict):
    """Gives each string that it has not met the next place."""

    def __missing__(self, key: str) -> int:
        self[key] = place = len(self)
        self.new.append(key)
        return place


class Memo:
    """Remembers what a function gives for strings: a run of integers and some numbers each.  Runs come as lists, or joined with their sizes as two arrays.

    When more than ``limit`` strings are known, or more than LETTERS characters for each of them, two thirds of that
    stay, those used most.  It only saves work; results do not depend on what is known.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[list | tuple[np.ndarray, np.ndarray], np.ndarray]], limit: int, dtype: type, extras: int = 0):
        self.learn, self.limit = learn, limit
        self.known, self.letters = _Places(), 0
        self.flat, self.starts, self.sizes = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.extra, self.uses = np.zeros((extras, 0)), np.zeros(0, np.int64)

    def _trim(self) -> None:
        old = list(self.known)
        order = np.argsort(-self.uses, kind="stable")[: self.limit * 2 // 3]
        size = np.fromiter(map(len, old), np.int64, len(old))
        kept = np.sort(order[np.cumsum(size[order]) <= self.limit * LETTERS * 2 // 3])
        self.flat, self.sizes, self.letters = self.runs(kept), self.sizes[kept], int(size[kept].sum())
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.extra, self.uses = self.extra[:, kept], self.uses[kept] // 2
        self.known = _Places({old[i]: n for n, i in enumerate(kept.tolist())})

    def index(self, lists: list[list[str]]) -> np.ndarray:
        """Places of all strings of all lists, in order; valid until the next call."""
        if len(self.known) > self.limit or self.letters > self.limit * LETTERS:
            self._trim()
        self.known.new = new = []
        out = np.fromiter(map(self.known.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))
        if new:
            self.letters += sum(map(len, new))
            flats, sizes, extras = [self.flat], [], [self.extra]
            for at in range(0, len(new), LEARN):
                runs, extra = self.learn(new[at : at + LEARN])
                if isinstance(runs, list):
                    size = np.fromiter(map(len, runs), np.int64, len(runs))
                    runs = np.fromiter(chain.from_iterable(runs), self.flat.dtype, int(size.sum())), size
                flats.append(runs[0])
                sizes.append(runs[1])
                extras.append(extra)
            size = np.concatenate(sizes)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(size) - size])
            self.flat, self.extra = np.concatenate(flats), np.concatenate(extras, axis=1)
            self.sizes, self.uses = np.concatenate([self.sizes, size]), np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.uses += np.bincount(out, minlength=len(self.uses))
        return out

    def runs(self, index: np.ndarray) -> np.ndarray:
        """The integers of the strings at ``index``, joined."""
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[index] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]

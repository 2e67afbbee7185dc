"""Reading, checking, writing and making point sets: rows (id, d0, d1, ...) of FLOAT coordinates."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.functions.storage import release, settle


def dims(points: DataFrame) -> list[str]:
    """Names of the coordinate columns, in order."""
    return sorted((c for c in points.columns if c[0] == "d" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def as_points(df: DataFrame, key: str | Column, coords: list[str | Column], kind: str = "float", check: bool = True) -> DataFrame:
    """Points from columns of a table.  With ``check``, a null or NaN coordinate raises when the row is read."""
    key = F.col(key) if isinstance(key, str) else key
    out = []
    for n, c in enumerate(coords):
        c = (F.col(c) if isinstance(c, str) else c).cast(kind)
        bad = F.raise_error(F.lit(f"coordinate {n} is null or NaN")).cast(kind)
        out.append((F.when(c.isNull() | F.isnan(c), bad).otherwise(c + F.lit(0).cast(kind)) if check else c).alias(f"d{n}"))
    return df.select(key.cast("long").alias("id"), *out)


#: Bytes of a point file that one task reads.
RANGE = 32 << 20
HEADER, HEADER_BYTES = "<II", 8


def _open(path: str):
    """A file of any store that Arrow knows, or of this machine."""
    store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    return store, name


def read_binary(spark: SparkSession, path: str, n: int | None = None, dimensions: int | None = None, piece: int = RANGE) -> DataFrame:
    """Points of a file: counts of points and dimensions as u32, then rows of f32, all little-endian.

    Fails if the header differs from what is expected or the file is short.  Ids
    are row numbers.  Tasks read ranges of about ``piece`` bytes, so a file may be of any size; all executors must reach it.
    """
    store, name = _open(path)
    size = store.get_file_info(name).size or 0
    with store.open_input_file(name) as f:
        head = f.read(HEADER_BYTES)
    if len(head) < HEADER_BYTES:
        raise ValueError("the file has no header")
    count, width = struct.unpack(HEADER, head)
    if n not in (None, count) or dimensions not in (None, width):
        raise ValueError(f"the file holds {count} points of {width} dimensions")
    if size < HEADER_BYTES + 4 * count * width:
        raise ValueError("the file is shorter than its header says")
    rows = max(1, piece // max(1, 4 * width))
    tasks = max(1, -(-count // rows))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = _open(path)
        for b in batches:
            for k in b.column(0).to_pylist():
                first, last = k * rows, min((k + 1) * rows, count)
                with own.open_input_file(place) as f:
                    f.seek(HEADER_BYTES + 4 * width * first)
                    for at in range(first, last, 65536):
                        m = min(65536, last - at)
                        x = np.frombuffer(f.read(4 * width * m), "<f4").reshape(m, width)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.arange(at, at + m)), *(pa.array(np.ascontiguousarray(x[:, c])) for c in range(width))],
                            names=["id", *(f"d{c}" for c in range(width))],
                        )

    schema = ", ".join(["id long", *(f"d{k} float" for k in range(width))])
    return spark.range(0, tasks, 1, tasks).mapInArrow(work, schema)


def write_binary(points: DataFrame, path: str, piece: int = 1 << 20) -> None:
    """Write that layout to one file, rows by id.

    Executors pack runs of rows; the driver appends the packed runs, of which it holds one partition at a time.
    """
    cols = dims(points)
    ranged = settle(points.select("id", *cols).repartitionByRange(max(1, -(-points.count() // piece)), "id").withColumn("part", F.spark_partition_id()), "ranged")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in cols], 1).astype("<f4")
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("part"))[:1], b.column(b.schema.get_field_index("id"))[:1], pa.array([x.tobytes()], pa.binary())], names=["part", "first", "raw"])

    ordered = ranged.repartition("part").sortWithinPartitions("part", "id")
    packed = settle(ordered.mapInArrow(pack, "part int, first long, raw binary"), "packed")
    store, name = _open(path)
    with store.open_output_stream(name) as f:
        f.write(struct.pack(HEADER, points.count(), len(cols)))
        for part in sorted(r.part for r in packed.select("part").distinct().collect()):
            for r in packed.where(F.col("part") == part).orderBy("first").toLocalIterator():
                f.write(r.raw)
    release(ranged, packed)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Points of text files: # lines are comments, other lines hold decimals between spaces.

    Ids follow the rows of a file (files in order of their paths), which may be split over tasks.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    lines = settle(lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")), "lines")
    counts, before = [], 0
    for r in lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("nth").alias("low")).orderBy("file", "block").collect():
        counts.append((r.file, r.block, before))
        before += r.n
    if not counts:
        raise ValueError("the file holds no points")
    first = spark.createDataFrame(counts, "file string, block long, first long")
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("nth"))
    rows = lines.withColumn("own", own).join(F.broadcast(first), ["file", "block"]).withColumn("id", F.col("first") + F.col("own") - 1)
    cells = F.split(F.trim("value"), r"\s+")
    width = lines.select(F.size(cells)).first()[0]
    return as_points(rows, "id", [F.get(cells, k) for k in range(width)])


def generate(spark: SparkSession, n: int, dimensions: int = 3, low: float = -1e15, high: float = 1e15, seed: int = 42) -> DataFrame:
    """Uniform points."""
    return spark.range(n).select("id", *[(F.rand(seed + k) * (high - low) + low).cast("float").alias(f"d{k}") for k in range(dimensions)])


def first_points(points: DataFrame, n: int = 10) -> DataFrame:
    """The first points by id, coordinates at four decimals."""
    return points.orderBy("id").limit(n).select("id", *[F.format_string("%.4f", c).alias(c) for c in dims(points)])

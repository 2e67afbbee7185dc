"""Building a k-d index.

Nodes are named by heap path: the root is 1, the children of n are 2n and 2n+1.
A node of more than ``leaf_size`` points splits its widest dimension at the
upper median; smaller values go left.  Large nodes are split level by level with
pre-aggregated counts, never by sorting a node in one task; once a node fits
``local_points`` it is finished in one task by NumPy.  A sketch of a sample can
stand for the upper levels: for a whole index, or to deal an index over parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.config import Config
from canopy.functions.storage import release, settle
from canopy.sources.points import dims

#: Coordinates of the points of a node that is finished in one task.
LOCAL_VALUES = 1 << 19
#: Bars of a histogram, and points that are ranked in one task to find a median; more are narrowed by histograms first.
BARS, RANKED = 1024, 1 << 16


@dataclass(frozen=True)
class Index:
    points: DataFrame  # id, d0.., leaf_id
    nodes: DataFrame  # node_id, parent_id, depth, is_leaf, split_dim, split_value, n_points, lo, hi, degenerate
    config: Config
    #: Batches of changes since the points were last written as one table.
    pending: int = 0

    def unpersist(self) -> None:
        """Delete the tables that were written for this index; it cannot be read after that."""
        release(self.points, self.nodes)

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.points.write.mode("overwrite").parquet(f"{path}/points")

    @classmethod
    def load(cls, spark, path: str, config: Config | None = None) -> Index:
        return cls(spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/nodes"), config or Config())


def kind_of(points: DataFrame) -> str:
    """The type that coordinates are kept in: DOUBLE if any of them is, FLOAT otherwise."""
    kinds = dict(points.dtypes)
    return "double" if any(kinds[c] == "double" for c in dims(points)) else "float"


def local_limit(points: DataFrame) -> int:
    return max(1, LOCAL_VALUES // max(1, len(dims(points))))


def widest(points: DataFrame, by: list[str]) -> DataFrame:
    """Per group: n, split_dim (widest range in FLOAT, ties to the lowest), the range, and its ends low and high."""
    cols = dims(points)
    spans = [F.struct((F.max(c) - F.min(c)).alias("span"), F.lit(-k).alias("neg"), F.min(c).alias("low"), F.max(c).alias("high")) for k, c in enumerate(cols)]
    best = F.array_max(F.array(*spans))
    return points.groupBy(*by).agg(F.count("*").alias("n"), best.alias("w")).select(
        *by, "n", (-F.col("w.neg")).alias("split_dim"), F.col("w.span").alias("span"), F.col("w.low").alias("low"), F.col("w.high").alias("high")
    )


def _chosen(points: DataFrame) -> Column:
    return F.get(F.array(*dims(points)), F.col("split_dim"))


def split_values(points: DataFrame, wide: DataFrame, by: list[str], ranked: int = RANKED) -> DataFrame:
    """Adds split_value to groups of ``wide``: the value at offset n div 2, or the next larger one if nothing is below it.

    Histograms with pre-aggregated counts narrow the range of the median until it
    holds at most ``ranked`` points or a single value; only those are ranked.
    Groups without spread have no split.
    """
    target = F.floor(F.col("n") / 2)
    rows = points.join(wide.where("span > 0").select(*by, "split_dim"), by).withColumn("v", _chosen(points)).select(*by, "v")
    near = wide.where("span > 0").select(
        *by, "n", "low", F.col("low").alias("a"), F.col("high").alias("z"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.lit(None).cast(kind_of(points)).alias("above")
    )
    state = [*by, "n", "low", "a", "z", "below", "inside", "above"]
    is_open = (F.col("inside") > ranked) & (F.col("a") < F.col("z"))
    while not near.where(is_open).isEmpty():
        place = (F.col("v").cast("double") - F.col("a")) / (F.col("z").cast("double") - F.col("a"))
        held = rows.join(near.where(is_open).select(*by, "a", "z"), by).where("v between a and z")
        bars = held.groupBy(*by, F.least(F.floor(place * BARS), F.lit(BARS - 1)).alias("bar")).agg(F.count("*").alias("c"), F.min("v").alias("first"), F.max("v").alias("last"))
        order = Window.partitionBy(*by).orderBy("bar")
        upto = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))
        bars = bars.select(*by, "c", "first", "last", upto.alias("upto"), F.min("first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("next"))
        hit = bars.join(near.select(*by, "n", "low", "below", "above"), by).where((F.col("below") + F.col("upto") > target) & (F.col("below") + F.col("upto") - F.col("c") <= target))
        hit = hit.select(
            *by, "n", "low", F.col("first").alias("a"), F.col("last").alias("z"), (F.col("below") + F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("inside"), F.coalesce("next", "above").alias("above")
        )
        near = settle(near.where(~is_open).unionByName(hit).select(*state), "brackets")
    counts = rows.join(near.select(*by, "a", "z"), by).where("v between a and z").groupBy(*by, "v").agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by).orderBy("v")
    values = counts.select(*by, "v", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.lead("v").over(order).alias("next"))
    found = values.join(near.select(*by, "n", "low", "below", "above"), by).where(F.col("below") + F.col("upto") > target)
    found = found.groupBy(*by).agg(F.min(F.struct("v", "next")).alias("m"), F.any_value("low").alias("low"), F.any_value("above").alias("above"))
    cut = F.when(F.col("m.v") > F.col("low"), F.col("m.v")).otherwise(F.coalesce("m.next", "above"))
    return wide.join(found.select(*by, cut.alias("split_value")), by, "left").select(*by, "n", "split_dim", "span", "split_value")


def grow(x: np.ndarray, root: int, leaf_size: int) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Leaf ids of points, and (node, dimension, value) of the splits below ``root``."""
    leaf, splits = np.empty(len(x), np.int64), []
    todo = [(root, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        if len(own) > leaf_size:
            lo, hi = x[own].min(0), x[own].max(0)
            d = int((hi - lo).argmax())
            v = x[own, d]
            if hi[d] - lo[d] > 0:
                cut = np.partition(v, len(v) // 2)[len(v) // 2]
                if cut == lo[d]:
                    cut = v[v > cut].min()
                splits.append((node, d, float(cut)))
                todo += [(2 * node, own[v < cut]), (2 * node + 1, own[v >= cut])]
                continue
        leaf[own] = node
    return leaf, splits


def depth_of(node: Column) -> Column:
    return F.length(F.bin(node)) - 1


def ancestors(node: Column) -> Column:
    """The node and all above it."""
    return F.transform(F.sequence(F.lit(0), depth_of(node)), lambda k: F.call_function("shiftright", node, k))


def leaf_sums(points: DataFrame) -> DataFrame:
    """(leaf_id, n, lo, hi) of the leaves of ``points``."""
    cols = dims(points)
    return points.groupBy("leaf_id").agg(F.count("*").alias("n"), F.array(*[F.min(c) for c in cols]).alias("lo"), F.array(*[F.max(c) for c in cols]).alias("hi"))


def roll_up(leaves: DataFrame, splits: DataFrame, leaf_size: int, k: int) -> DataFrame:
    """The table of nodes from the sums of leaves and the splits: sums and bounds go up the paths."""
    up = leaves.select("n", "lo", "hi", F.explode(ancestors(F.col("leaf_id"))).alias("node_id"))
    rolled = up.groupBy("node_id").agg(
        F.sum("n").alias("n_points"), F.array(*[F.min(F.get("lo", i)) for i in range(k)]).alias("lo"), F.array(*[F.max(F.get("hi", i)) for i in range(k)]).alias("hi")
    )
    leaf = F.col("split_dim").isNull()
    return rolled.join(splits, "node_id", "left").select(
        "node_id", F.when(F.col("node_id") > 1, F.shiftright("node_id", 1)).alias("parent_id"), depth_of(F.col("node_id")).alias("depth"), leaf.alias("is_leaf"),
        "split_dim", "split_value", "n_points", F.when(~leaf, F.col("n_points")).alias("approx_counter"), "lo", "hi", (leaf & (F.col("n_points") > leaf_size)).alias("degenerate"),
    )


def summarise(points: DataFrame, splits: DataFrame, leaf_size: int) -> DataFrame:
    """The table of nodes from leaf ids and splits."""
    return roll_up(leaf_sums(points), splits, leaf_size, len(dims(points)))


def _finish(points: DataFrame, splits: list[DataFrame], config: Config) -> Index:
    """Finish nodes that fit a task.  ``points`` has node_id and ``done`` (nothing left to split)."""
    cols, leaf_size, kind = dims(points), config.leaf_size, kind_of(points)
    dtype = np.float64 if kind == "double" else np.float32

    def local(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, found = grow(pdf[cols].to_numpy(dtype), int(key[0]), leaf_size)
        n, m = len(pdf), len(found)
        out = {"id": pd.array([*pdf["id"], *[None] * m], "Int64"), **{c: np.append(pdf[c].to_numpy(dtype), np.zeros(m, dtype)) for c in cols}}
        out["leaf_id"] = np.append(leaf, np.array([f[0] for f in found], np.int64))
        out["split_dim"] = pd.array([*[None] * n, *(f[1] for f in found)], "Int32")
        out["split_value"] = np.append(np.zeros(n, dtype), np.array([f[2] for f in found], dtype))
        return pd.DataFrame(out)

    schema = ", ".join(["id long", *(f"{c} {kind}" for c in cols), "leaf_id long", "split_dim int", f"split_value {kind}"])
    grown = settle(points.where("not done").groupBy("node_id").applyInPandas(local, schema), "grown")
    rows = grown.where("split_dim is null").select("id", *cols, "leaf_id")
    rows = rows.unionByName(points.where("done").select("id", *cols, F.col("node_id").alias("leaf_id")))
    rows = settle(rows, "points")
    all_splits = grown.where("split_dim is not null").select(F.col("leaf_id").alias("node_id"), "split_dim", "split_value")
    for s in splits:
        all_splits = all_splits.unionByName(s)
    index = Index(rows, settle(summarise(rows, all_splits, leaf_size), "nodes"), config)
    release(grown, *splits)
    return index


def build_exact(points: DataFrame, config: Config | None = None, local_points: int | None = None, root: int = 1) -> Index:
    """The exact index.  Levels above ``local_points`` take a fixed number of aggregations each."""
    config = config or Config(dimensions=len(dims(points)))
    cols = dims(points)
    start = points.select("id", *cols, F.lit(root).cast("long").alias("node_id"), F.lit(False).alias("done"))
    return continue_exact(settle(start, "level"), config, local_points)


def continue_exact(cur: DataFrame, config: Config, local_points: int | None = None, splits: list[DataFrame] | None = None) -> Index:
    """Split from the nodes that the points are at (node_id; ``done`` if there is nothing to split).

    ``cur`` is a settled table of its own, deleted when the next level is written;
    ``splits`` are those of the levels above.
    """
    cols = dims(cur)
    splits, limit = list(splits or []), max(local_points or local_limit(cur), config.leaf_size)
    while True:
        large = settle(widest(cur.where("not done"), ["node_id"]).where(F.col("n") > limit), "wide")
        if large.isEmpty():
            index = _finish(cur, splits, config)
            release(cur, large)
            return index
        found = settle(split_values(cur, large, ["node_id"]).select("node_id", "split_dim", "split_value"), "splits")
        splits.append(found.where("split_value is not null"))
        right = (_chosen(cur) >= F.col("split_value")).cast("long")
        moved = cur.join(found.withColumn("met", F.lit(True)), "node_id", "left")
        moved = moved.select(
            "id", *cols, F.when(F.col("split_value").isNotNull(), F.col("node_id") * 2 + right).otherwise(F.col("node_id")).alias("node_id"),
            (F.col("done") | (F.col("met").isNotNull() & F.col("split_value").isNull())).alias("done"),
        )
        cur, old = settle(moved, "level"), cur
        release(old, large)


def sketch(sample: np.ndarray, height: int) -> list[tuple[int, int, float]]:
    """Splits of the exact tree over a sample, ``height`` levels deep."""
    splits, todo = [], [(1, sample)]
    while todo:
        node, x = todo.pop()
        if node >= 2**height or len(x) < 2:
            continue
        d = int((x.max(0) - x.min(0)).argmax())
        cut = np.partition(x[:, d], len(x) // 2)[len(x) // 2]
        if cut == x[:, d].min():
            above = x[:, d][x[:, d] > cut]
            if not len(above):
                continue
            cut = above.min()
        splits.append((node, d, float(cut)))
        todo += [(2 * node, x[x[:, d] < cut]), (2 * node + 1, x[x[:, d] >= cut])]
    return splits


def route(splits: list[tuple[int, int, float]], cols: list[str], node: int = 1) -> Column:
    """The node that a point falls to, as one nested CASE; at most 64 leaves are sensible."""
    at = {s[0]: s for s in splits}

    def below(n):
        if n not in at:
            return F.lit(n).cast("long")
        _, d, v = at[n]
        return F.when(F.col(cols[d]) < F.lit(v).cast("float"), below(2 * n)).otherwise(below(2 * n + 1))

    return below(node)


def _sketched(points: DataFrame, config: Config, height: int, want: int, seed: int) -> list[tuple[int, int, float]]:
    """Splits of a sample of about ``want`` points; twice as many reach the driver at most."""
    n = points.count()
    if n <= config.leaf_size:
        return []
    sample = points.sample(True, min(1.0, 1.3 * want / n), seed).limit(2 * want).select(*dims(points)).toPandas().to_numpy(np.float32)
    return sketch(sample, height)


def _from_sketch(points: DataFrame, splits: list[tuple[int, int, float]], config: Config) -> Index:
    cols = dims(points)
    routed = points.select("id", *cols, route(splits, cols).alias("node_id"), F.lit(False).alias("done"))
    # a split with no point of the table on one side has no row for that side
    table = points.sparkSession.createDataFrame(splits, "node_id long, split_dim int, split_value float")
    return continue_exact(settle(routed, "routed"), config, splits=[table])


def build_sampled(points: DataFrame, config: Config | None = None, seed: int = 7) -> Index:
    """A sketch of a bounded sample routes the points to buckets, which are finished apart; buckets over the local limit are split exactly first."""
    config = config or Config(dimensions=len(dims(points)))
    splits = _sketched(points, config, config.sketch_height, config.chunk_size * config.oversampling, seed)
    return _from_sketch(points, splits, config)


def assign(points: DataFrame, splits: list[tuple[int, int, float]], n_parts: int) -> DataFrame:
    """``points`` with their bucket in a sketch, and the part that has the bucket."""
    bucket = route(splits, dims(points))
    return points.withColumn("bucket", bucket).withColumn("part_id", F.pmod(F.col("bucket"), F.lit(n_parts)).cast("int"))


def build_parts(points: DataFrame, config: Config | None = None, seed: int = 7) -> tuple[Index, DataFrame]:
    """An index dealt over ``n_parts`` parts, and (bucket, part_id, n) of the buckets.

    A sample of n_parts * oversampling points gives a sketch with a bucket for each
    part or more; bucket b goes to part b mod n_parts, where its subtree is built.
    """
    config = config or Config(dimensions=len(dims(points)))
    height = max(0, (config.n_parts - 1).bit_length())
    splits = _sketched(points, config, height, config.n_parts * config.oversampling, seed)
    index = _from_sketch(points, splits, config)
    return index, settle(assign(points, splits, config.n_parts).groupBy("bucket", "part_id").agg(F.count("*").alias("n")), "buckets")


def part_of_nodes(nodes: DataFrame, buckets: DataFrame) -> DataFrame:
    """``nodes`` with the part that has their bucket; null for nodes above the buckets."""
    up = nodes.select("node_id", F.explode(ancestors(F.col("node_id"))).alias("bucket"))
    return nodes.join(up.join(buckets.select("bucket", "part_id"), "bucket").drop("bucket"), "node_id", "left")


def build(points: DataFrame, config: Config | None = None, mode: str = "auto") -> Index:
    """``exact``, ``sampled``, ``parts``, or by size: sampled from chunk_size * oversampling points on."""
    config = config or Config(dimensions=len(dims(points)))
    if mode == "auto":
        limit = config.chunk_size * config.oversampling
        mode = "exact" if points.limit(limit).count() < limit else "sampled"
    return {"exact": build_exact, "sampled": build_sampled, "parts": lambda p, c: build_parts(p, c)[0]}[mode](points, config)

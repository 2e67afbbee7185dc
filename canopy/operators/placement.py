"""Where nodes and queries go: groups, levels, parts, push or pull."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.search import running

#: Bytes that a node takes on a part, beside its points.
NODE_BYTES = 64


def _log2(x: float) -> int:
    return int(math.log2(x)) if x > 0 else 0


def group_count(n: int, leaf_size: int = 32) -> int:
    """One, and one for each whole-number log2 from n on until it is at most ``leaf_size``."""
    groups = 1
    while n > leaf_size:
        n, groups = _log2(n), groups + 1
    return groups


def node_group(size: Column, groups: int) -> Column:
    """Group i holds sizes in (2^(2^(i-1)), 2^(2^i)], group 0 those in (0, 2]; others get -1."""
    out = F.when((size > 0) & (size <= 2), F.lit(0))
    for i in range(1, min(groups, 6)):
        out = out.when((size > 2 ** (2 ** (i - 1))) & (size <= 2 ** (2**i)), F.lit(i))
    return out.otherwise(F.lit(-1))


def scatter_level(size: Column, n: int, leaf_size: int = 32) -> Column:
    """0 up to ``leaf_size``; else the steps of whole-number log2 from n while the value is over both limits."""
    cuts, cur = [], n
    while cur > leaf_size:
        cuts.append(cur)
        cur = _log2(cur)
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(size < c, F.lit(1)).otherwise(F.lit(0))
    return F.when(size <= leaf_size, F.lit(0)).otherwise(out)


def hashed_part(node: Column, replica: Column, n_parts: int) -> Column:
    """The part of a copy of a node: a number made of the first 32 bits of an MD5, which other engines have too."""
    digest = F.substring(F.md5(F.concat_ws(":", node.cast("string"), replica.cast("string"))), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(n_parts)).cast("int")


def placement(nodes: DataFrame, n: int, n_parts: int = 64, leaf_size: int = 32) -> DataFrame:
    """(node_id, part_id, replica, level, n_points): nodes of level 1 and up have a copy per part, at hashed parts."""
    level = scatter_level(F.col("n_points"), n, leaf_size)
    copies = nodes.select("node_id", "n_points", level.alias("level")).withColumn(
        "replica", F.explode(F.when(F.col("level") > 0, F.sequence(F.lit(0), F.lit(n_parts - 1))).otherwise(F.array(F.lit(0))))
    )
    return copies.select("node_id", hashed_part(F.col("node_id"), F.col("replica"), n_parts).alias("part_id"), "replica", "level", "n_points")


def offsets(placed: DataFrame, bytes_per_point: int = 12) -> DataFrame:
    """Adds ``offset``: the bytes that earlier nodes take on the same part."""
    sized = placed.withColumn("bytes", (F.col("n_points") * bytes_per_point).cast("long"))
    whole = running(sized, ["part_id", "node_id", "replica"], "bytes", "upto")
    first = whole.groupBy("part_id").agg(F.min("upto").alias("first"))
    return whole.join(F.broadcast(first), "part_id").withColumn("offset", F.col("upto") - F.col("first")).select(*placed.columns, "offset")


def node_parts(placed: DataFrame) -> DataFrame:
    """(node_id, part_id): the first registered part of each node."""
    return placed.groupBy("node_id").agg(F.min_by("part_id", "replica").alias("part_id"))


def find_parts(nodes: DataFrame, placed: DataFrame, n_parts: int = 64) -> DataFrame:
    """(node_id, part_id) of ``nodes``: the first registered part, or a hashed one if there is none."""
    found = nodes.select("node_id").join(node_parts(placed), "node_id", "left")
    return found.select("node_id", F.coalesce("part_id", hashed_part(F.col("node_id"), F.lit(0), n_parts)).alias("part_id"))


def load(placed: DataFrame, n_parts: int, bytes_per_point: int = 12) -> DataFrame:
    """Per part: nodes, replicas, points, bytes, and load, the share of nodes against an even deal."""
    size = F.col("n_points") * bytes_per_point + NODE_BYTES
    per = placed.groupBy("part_id").agg(
        F.count("*").alias("nodes"), F.sum((F.col("replica") > 0).cast("long")).alias("replicas"), F.sum("n_points").alias("points"), F.sum(size).cast("long").alias("bytes")
    )
    total = placed.agg(F.count("*").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("part_id", "nodes", "replicas", "points", "bytes", (F.col("nodes") * n_parts / F.col("total")).alias("load"))


def load_totals(loads: DataFrame, n_parts: int) -> DataFrame:
    """One row over all parts: nodes, replicas, points and bytes, and the nodes and bytes of a part on average."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("nodes", "replicas", "points", "bytes")]
    return loads.agg(*sums).select("*", (F.col("nodes") / n_parts).alias("avg_nodes"), (F.col("bytes") / n_parts).alias("avg_bytes"))


def prefix_sums(counts: DataFrame) -> DataFrame:
    """(bucket, chunk, n, before): exclusive running sums of (bucket, chunk, n) tables, in that order."""
    return running(counts, ["bucket", "chunk"], "n", "before")


def group_height(g: int, n_parts: int = 64) -> int:
    """log2 taken g times from n_parts, never under 1, and one more, cut to a whole number."""
    x = float(n_parts)
    for _ in range(g):
        x = max(1.0, math.log2(x)) if x > 0 else 1.0
    return int(x + 1)


def search_groups(n_parts: int = 64) -> int:
    x, n = float(n_parts), 0
    while x > 1:
        x, n = math.log2(x), n + 1
    return n


def thresholds(n_parts: int = 64) -> list[int]:
    """How many queries at a node of each group make it worth fetching the node."""
    return [2 * group_height(g, n_parts) for g in range(search_groups(n_parts))]


def pulls(count: Column, group: Column, is_leaf: Column, limits: list[int], fanout: int = 2, forced: bool = False) -> Column:
    """Whether a node goes to its queries (a broadcast) instead of the queries to the node (a shuffle)."""
    if forced:
        return F.lit(True)
    limit = F.lit(4 * fanout)
    for g in reversed(range(len(limits))):
        limit = F.when(group == g, F.lit(limits[g])).otherwise(limit)
    return ~is_leaf & (count > limit)


def even_deal(queries: DataFrame, n_parts: int) -> DataFrame:
    """Queries in even runs by id, the first runs one longer."""
    placed = running(queries.withColumn("_one", F.lit(1).cast("long")), ["id"], "_one", "_nth").drop("_one")
    total = queries.agg(F.count("*").alias("_n"))
    base, more = F.floor(F.col("_n") / n_parts), F.col("_n") % n_parts
    long_runs = more * (base + 1)
    part = F.when(F.col("_nth") < long_runs, F.floor(F.col("_nth") / (base + 1))).otherwise(more + F.floor((F.col("_nth") - long_runs) / F.greatest(base, F.lit(1))))
    return placed.crossJoin(F.broadcast(total)).withColumn("part_id", part.cast("int")).drop("_n", "_nth")

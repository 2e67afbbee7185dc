"""Balance and approximate counters of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.build import ancestors


def update_chance(value: Column, n: Column, beta: float = 2.0) -> Column:
    """log2(n) / (beta * value); a zero counter or fewer than two points never move (0)."""
    return F.when((value <= 0) | (n <= 1), F.lit(0.0)).otherwise(F.log2(n.cast("double")) / (beta * value))


def increment(value: Column, n: Column, beta: float = 2.0) -> Column:
    """The step 1 / chance, cut to a whole number: zero while the chance is over 1."""
    p = update_chance(value, n, beta)
    return F.when(p > 0, F.floor(1 / p)).otherwise(F.lit(0)).cast("long")


def approximate(value: Column, n: Column, up: bool, beta: float = 2.0, seed: int = 42) -> Column:
    """A counter after one random update; downwards it stops at 1, and zero stays zero."""
    hit = F.rand(seed) < update_chance(value, n, beta)
    step = increment(value, n, beta)
    moved = value + step if up else F.greatest(value - step, F.lit(1).cast("long"))
    return F.when(hit, moved).otherwise(value)


def propagate(nodes: DataFrame, deltas: DataFrame, lowest: str = "exact", n: int | None = None, beta: float = 2.0, seed: int = 42) -> DataFrame:
    """Updates: (leaf_id, weight) rows move the counters of all nodes above; a positive counter stops at 1.

    With ``lowest="random"`` the lowest internal node above a leaf makes one random
    update in the direction of the leaf's sum, as approximate counters do (``n`` is
    the size of the tree), while the nodes above it move by the exact sums.
    """
    sums = deltas.groupBy("leaf_id").agg(F.sum("weight").alias("w"))
    up = sums.withColumn("node_id", F.explode(ancestors(F.col("leaf_id"))))
    if lowest == "random":
        up = up.where(F.col("node_id") <= F.shiftright("leaf_id", 2))
    sums = sums.select("leaf_id", "w")
    moves = up.groupBy("node_id").agg(F.sum("w").alias("delta"))
    moved = F.col("approx_counter") + F.coalesce("delta", F.lit(0))
    out = nodes.join(moves, "node_id", "left").withColumn("approx_counter", F.when(F.col("approx_counter") > 0, F.greatest(moved, F.lit(1).cast("long"))).otherwise(moved)).drop("delta")
    if lowest != "random":
        return out
    # two leaves may have one lowest node: the left one's update comes first
    for side in (0, 1):
        own = sums.where(F.pmod("leaf_id", F.lit(2)) == side).select(F.shiftright("leaf_id", 1).alias("node_id"), F.signum("w").alias("way"))
        value = F.col("approx_counter")
        up_, down = (approximate(value, F.lit(n), way, beta, seed + side) for way in (True, False))
        out = out.join(own, "node_id", "left").withColumn("approx_counter", F.when(F.col("way") > 0, up_).when(F.col("way") < 0, down).otherwise(value)).drop("way")
    return out


def children(nodes: DataFrame) -> DataFrame:
    """(node_id, counter, left_n, right_n) of internal nodes; a missing child is null."""
    size = F.when(F.col("is_leaf"), F.col("n_points")).otherwise(F.col("approx_counter"))
    kids = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(
        F.max(F.when(F.pmod("node_id", F.lit(2)) == 0, size)).alias("left_n"), F.max(F.when(F.pmod("node_id", F.lit(2)) == 1, size)).alias("right_n")
    )
    return nodes.where("not is_leaf").select("node_id", F.col("approx_counter").alias("counter")).join(kids, "node_id", "left")


def violations(nodes: DataFrame, alpha: float = 2.0) -> DataFrame:
    """(node_id, left_n, right_n, violates): the larger side is over 1 + alpha times the smaller, or a child is missing."""
    larger, smaller = F.greatest("left_n", "right_n"), F.least("left_n", "right_n")
    missing = F.col("left_n").isNull() | F.col("right_n").isNull()
    return children(nodes).select("node_id", "left_n", "right_n", (missing | (larger > (1 + alpha) * smaller)).alias("violates"))


def first_imbalance(nodes: DataFrame, alpha: float = 2.0) -> DataFrame:
    """(leaf_id, node_id): the nearest violating node above each leaf that has one."""
    up = nodes.where("is_leaf").select(F.col("node_id").alias("leaf_id"), F.explode(ancestors(F.col("node_id"))).alias("node_id"))
    return up.join(violations(nodes, alpha).where("violates").select("node_id"), "node_id", "left_semi").groupBy("leaf_id").agg(F.max("node_id").alias("node_id"))


def consistency(nodes: DataFrame) -> DataFrame:
    """(node_id, ratio, consistent): counter against the sum of the children, consistent from 0.5 to 2; a sum of 0 needs a counter of 0."""
    total = F.coalesce("left_n", F.lit(0)) + F.coalesce("right_n", F.lit(0))
    ratio = F.when(total > 0, F.col("counter") / total)
    return children(nodes).select("node_id", ratio.alias("ratio"), F.when(total > 0, ratio.between(0.5, 2.0)).otherwise(F.col("counter") == 0).alias("consistent"))

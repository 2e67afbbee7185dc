"""Connected components by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.storage import release, settle


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    )


def _in_memory(edges: DataFrame) -> DataFrame:
    """The labels of ``components``, by hooking and pointer doubling over arrays."""
    table = edges.select("u", "v").toArrow()
    ids, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in "uv"]), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            below = root < np.arange(len(ids))
            return edges.sparkSession.createDataFrame(pa.table({"u": ids[below], "root": ids[root][below]}))
        # roots hook to smaller ones, and every node then follows to the end
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root[root] == root).all():
            root = root[root]


def components(edges: DataFrame, max_rounds: int = 10_000, in_memory: int = 0) -> DataFrame:
    """Label the nodes of an undirected graph with the smallest id they reach.

    ``edges`` has two BIGINT columns ``u`` and ``v``; direction, repeats and
    self-loops do not matter.  Returns ``(u, root)`` for every node that has an
    edge to another node; isolated nodes are absent.  An empty edge table gives
    an empty result.

    Each round hooks every node to the smallest neighbour (first of all larger
    neighbours, then of all smaller ones).  The number of edges never grows and
    the rounds needed grow with the logarithm of the longest path.  Round
    results are written to shared storage, which bounds lineage and lets the
    joins see plain shuffles, whose hot keys adaptive execution splits.  Up to
    ``in_memory`` edges are labelled by the driver instead.
    """
    cur = edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).where("u <> v").distinct()
    cur = settle(cur, "cc")
    before = _state(cur)
    if before[0] == 0:
        return cur.select("u", F.col("v").alias("root"))
    if before[0] <= in_memory:
        return _in_memory(cur)
    for _ in range(max_rounds):
        start = cur
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "cc")
        cur = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        cur = settle(cur, "cc")
        release(start, low)
        middle = cur
        low = settle(cur.groupBy("u").agg(F.min("v").alias("m")), "cc")
        cur = (
            cur.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        cur = settle(cur, "cc")
        release(middle, low)
        after = _state(cur)
        if after == before:
            return cur.select("u", F.col("v").alias("root"))
        before = after
    raise RuntimeError("components did not converge")

"""Batches of insertions and deletions, with partial rebuilds.

A batch reads the points that it touches and writes those and the nodes; other
points stay in the tables where they are.  The points of an index are then a
union of what is left of older tables and newer ones; after COMPACT batches they
are written as one table again.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.storage import release, settle
from canopy.operators.build import Index, ancestors, build_exact, continue_exact, leaf_sums, roll_up
from canopy.operators.counters import violations
from canopy.operators.search import locate
from canopy.sources.points import dims

TOLERANCE = 1e-6
#: Batches after which the points are written as one table.
COMPACT = 8
#: Cells of the grid for deletions, in tolerances.
CELL = 1024


def _under(tops: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of ``ids`` whose node ``name`` is at or below one of ``tops`` (top)."""
    return ids.withColumn("top", F.explode(ancestors(F.col(name)))).join(tops, "top", "left_semi")


def _updated(index: Index, points: DataFrame, touched: DataFrame) -> Index:
    """``points`` as an index, of which only leaves ``touched`` (leaf_id) have changed.

    Sums and bounds of these leaves are taken anew and go up the paths; topmost
    violating nodes and leaves over the limit are built anew, the rest stays.
    """
    cfg, cols, k = index.config, dims(points), len(dims(points))
    splits = index.nodes.where("not is_leaf").select("node_id", "split_dim", "split_value")
    old = index.nodes.where("is_leaf").select(F.col("node_id").alias("leaf_id"), F.col("n_points").alias("n"), "lo", "hi")
    anew = leaf_sums(points.join(touched, "leaf_id", "left_semi"))
    leaves = settle(old.join(touched, "leaf_id", "left_anti").unionByName(anew), "leaf-sums")
    nodes = settle(roll_up(leaves, splits, cfg.leaf_size, k), "updated-nodes")
    bad = violations(nodes, cfg.alpha).where("violates").select("node_id")
    full = nodes.where(F.col("is_leaf") & (F.col("n_points") > cfg.leaf_size) & F.exists(F.zip_with("lo", "hi", lambda a, b: b > a), lambda x: x)).select("node_id")
    bad = settle(bad.unionByName(full).distinct(), "violating")
    above = bad.withColumn("up", F.explode(ancestors(F.col("node_id")))).where("up <> node_id")
    below_another = above.join(bad.select(F.col("node_id").alias("up")), "up", "left_semi").select("node_id").distinct()
    tops = settle(bad.join(below_another, "node_id", "left_anti").select(F.col("node_id").alias("top")), "tops")
    pending = index.pending + 1
    if not tops.isEmpty():
        gone = settle(_under(tops, leaves.select("leaf_id"), "leaf_id").select("leaf_id", "top"), "rebuilt-leaves")
        start = points.join(gone, "leaf_id").select("id", *cols, F.col("top").alias("node_id"), F.lit(False).alias("done"))
        fresh = continue_exact(settle(start, "level"), cfg)
        points = points.join(gone, "leaf_id", "left_anti").select("id", *cols, "leaf_id").unionByName(fresh.points.select("id", *cols, "leaf_id"))
        # nodes above the rebuilt roots hold only the moved points in ``fresh``: the old tree has theirs
        inside = _under(tops, fresh.nodes.where("not is_leaf").select("node_id", "split_dim", "split_value"), "node_id").select("node_id", "split_dim", "split_value")
        kept = splits.join(_under(tops, splits.select("node_id"), "node_id").select("node_id"), "node_id", "left_anti")
        sums = fresh.nodes.where("is_leaf").select(F.col("node_id").alias("leaf_id"), F.col("n_points").alias("n"), "lo", "hi")
        sums = _under(tops, sums, "leaf_id").drop("top")
        leaves = leaves.join(gone, "leaf_id", "left_anti").unionByName(sums)
        nodes = settle(roll_up(leaves, kept.unionByName(inside), cfg.leaf_size, k), "nodes")
        release(fresh.nodes)
    if pending >= COMPACT:
        points, pending = settle(points, "points"), 0
    return replace(index, points=points, nodes=nodes, pending=pending)


def insert(index: Index, batch: DataFrame) -> Index:
    """A multiset union: each row of ``batch`` (id, d..) is added once."""
    cols = dims(index.points)
    batch = batch.select("id", *cols)
    if index.nodes.isEmpty():
        return build_exact(batch, index.config)
    added = locate(index, batch).select("id", *cols, "leaf_id")
    found = settle(added, "added")
    if found.count() < batch.count():  # a place in the tree that holds no points has no node yet
        found = settle(found.unionByName(_homeless(index, batch.join(found.select("id"), "id", "left_anti"))), "added")
    points = index.points.select("id", *cols, "leaf_id").unionByName(found)
    return _updated(index, points, found.select("leaf_id").distinct())


def _homeless(index: Index, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` with the missing child that their path leads to: it becomes a leaf."""
    cols = dims(batch)
    inner = index.nodes.where("not is_leaf").select(F.col("node_id").alias("at"), "split_dim", "split_value")
    nodes = index.nodes.select(F.col("node_id").alias("to"), F.lit(True).alias("there"))
    cur, out = batch.withColumn("at", F.lit(1).cast("long")), None
    while not cur.isEmpty():
        step = cur.join(inner, "at").withColumn("to", F.col("at") * 2 + (F.get(F.array(*cols), F.col("split_dim")) >= F.col("split_value")).cast("long"))
        step = settle(step.join(nodes, "to", "left").select("id", *cols, "to", "there"), "steps")
        lost = step.where("there is null").select("id", *cols, F.col("to").alias("leaf_id"))
        out = lost if out is None else out.unionByName(lost)
        cur = step.where("there").select("id", *cols, F.col("to").alias("at"))
    return out


def _cells(value, tolerance: float) -> list:
    """First and last cell that a FLOAT may share with others within the tolerance.

    From tolerance * 2^24 on, two different FLOATs are further apart than the tolerance: there a value is its own cell.
    """
    x, width = value.cast("double"), tolerance * CELL
    near = F.abs(x) < tolerance * 2.0**24
    ends = [F.when(near, F.floor(F.when(near, (x + s) / width).otherwise(0.0))).otherwise(F.xxhash64(value.cast("float"))) for s in (-tolerance, 0.0, tolerance)]
    return ends


def _close(points: DataFrame, requests: DataFrame, tolerance: float) -> DataFrame:
    """(request, wanted, id) of points whose coordinates are all within the tolerance of those of a request."""
    cols = dims(points)
    cells = [f"c{n}" for n in range(len(cols))]
    stored = points.select("id", *[F.col(c).alias(f"p{n}") for n, c in enumerate(cols)], *[_cells(F.col(c), tolerance)[1].alias(x) for c, x in zip(cols, cells, strict=True)])
    asked = requests
    for c, x in zip(cols, cells, strict=True):
        first, _, last = _cells(F.col(c), tolerance)
        asked = asked.withColumn(x, F.explode(F.array_distinct(F.array(first, last))))
    good = F.lit(True)
    for n, c in enumerate(cols):
        good = good & (F.abs((F.col(c) - F.col(f"p{n}")).cast("double")) <= F.lit(tolerance))
    return asked.join(stored, cells).where(good).select("request", "wanted", "id")


def matched(points: DataFrame, requests: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(request, id): stored points that requests take away, one each at most.

    Coordinates agree if their difference, taken in FLOAT, is within the tolerance.  Requests with the same coordinates
    (named by the smallest id among them) first take points with just these coordinates, in order of id.  What is then wanted
    still is taken from other points within reach: requests in order of id, points in order of id, until nothing more can be.
    A request without a point is passed over.
    """
    cols = dims(points)
    asked = settle(requests.groupBy(*cols).agg(F.count("*").alias("wanted"), F.min("id").alias("request")), "asked")
    same = points.join(asked, cols).select("request", "wanted", "id")
    order = Window.partitionBy("request").orderBy("id")
    exact = settle(same.withColumn("n", F.row_number().over(order)).where("n <= wanted").select("request", "id"), "exact")
    got = exact.groupBy("request").agg(F.count("*").alias("got"))
    more = asked.join(got, "request", "left").withColumn("wanted", F.col("wanted") - F.coalesce("got", F.lit(0))).where("wanted > 0").drop("got")
    pairs = settle(_close(points, more, tolerance).join(exact.select("id"), "id", "left_anti"), "close")
    if pairs.isEmpty():
        return exact
    # each request asks for the first points that have not refused it; a point keeps the first request and refuses the others for good
    while True:
        chosen = pairs.withColumn("n", F.row_number().over(order)).where("n <= wanted")
        chosen = settle(chosen.withColumn("first", F.min("request").over(Window.partitionBy("id"))).select("request", "id", "first"), "chosen")
        refused = chosen.where("request > first")
        if refused.isEmpty():
            return exact.unionByName(chosen.select("request", "id"))
        pairs, old = settle(pairs.join(refused.select("request", "id"), ["request", "id"], "left_anti"), "close"), pairs
        release(old, chosen)


def delete(index: Index, requests: DataFrame, tolerance: float = TOLERANCE) -> tuple[Index, int]:
    """The index without one stored point per request, and the number of rows removed."""
    cols = dims(index.points)
    gone = matched(index.points, requests.select("id", *cols), tolerance)
    gone = settle(index.points.join(gone.select("id"), "id", "left_semi").select("id", "leaf_id"), "gone")
    left = index.points.join(gone, ["id", "leaf_id"], "left_anti").select("id", *cols, "leaf_id")
    return _updated(index, left, gone.select("leaf_id").distinct()), gone.count()


def path_deltas(leaf_ids: DataFrame) -> DataFrame:
    """(node_id, delta): how many rows of ``leaf_ids`` (leaf_id, weight) lie at or below each node."""
    sums = leaf_ids.groupBy("leaf_id").agg(F.sum("weight").alias("w"))
    return sums.withColumn("node_id", F.explode(ancestors(F.col("leaf_id")))).groupBy("node_id").agg(F.sum("w").alias("delta"))


__all__ = ["delete", "insert", "matched", "path_deltas"]

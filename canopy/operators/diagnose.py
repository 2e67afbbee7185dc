"""Reports on an index."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.operators.build import Index, part_of_nodes
from canopy.operators.counters import children, consistency
from canopy.operators.placement import load, load_totals, placement
from canopy.sources.points import dims


def stats(nodes: DataFrame) -> DataFrame:
    """One row: internal and leaf nodes, points, depths, leaf sizes, mean counter, balance of the root."""
    leaf = F.col("is_leaf")
    root = children(nodes).where("node_id = 1").select(
        F.when((F.col("left_n") > 0) & (F.col("right_n") > 0), F.least("left_n", "right_n") / (F.col("left_n") + F.col("right_n"))).otherwise(0.0).alias("root_balance")
    )
    total = nodes.agg(
        F.sum((~leaf).cast("long")).alias("internal"), F.sum(leaf.cast("long")).alias("leaves"), F.sum(F.when(leaf, F.col("n_points"))).alias("points"),
        F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.avg(F.when(leaf, F.col("n_points"))).alias("avg_leaf"),
        F.max(F.when(leaf, F.col("n_points"))).alias("max_leaf"), F.avg(F.col("approx_counter")).alias("avg_counter"),
    )
    return total.join(F.broadcast(root), F.lit(True), "left")


def validate(nodes: DataFrame) -> DataFrame:
    """One row: nodes, nodes without their parent, internal nodes without children, nodes that are their own parent."""
    ids = nodes.select(F.col("node_id").alias("p"))
    kids = nodes.select(F.col("parent_id").alias("p")).distinct()
    orphans = nodes.where("parent_id is not null").join(ids, F.col("parent_id") == F.col("p"), "left_anti").agg(F.count("*").alias("invalid_parents"))
    bare = nodes.where("not is_leaf").join(kids, F.col("node_id") == F.col("p"), "left_anti").agg(F.count("*").alias("childless"))
    own = nodes.agg(F.count("*").alias("visited"), F.coalesce(F.sum((F.col("node_id") == F.col("parent_id")).cast("long")), F.lit(0)).alias("self_cycles"))
    return own.crossJoin(orphans).crossJoin(bare)


def counter_report(nodes: DataFrame) -> DataFrame:
    """One row: internal nodes, inconsistent and zero counters, least and largest ratio."""
    zero = nodes.where("not is_leaf and approx_counter = 0").agg(F.count("*").alias("zero_counters"))
    seen = consistency(nodes).agg(F.count("*").alias("checked"), F.coalesce(F.sum((~F.col("consistent")).cast("long")), F.lit(0)).alias("inconsistent"), F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"))
    return seen.crossJoin(zero)


#: Points of a leaf that are listed.
LISTED = 5
RULE, BOLD_RULE = "-" * 72, "=" * 72


def _first_points(index: Index) -> DataFrame:
    """(leaf_id, first): coordinates of the first points of each leaf by id."""
    rank = F.row_number().over(Window.partitionBy("leaf_id").orderBy("id"))
    few = index.points.withColumn("k", rank).where(F.col("k") <= LISTED)
    few = few.withColumn("p", F.concat_ws(",", *dims(index.points)))
    return few.groupBy("leaf_id").agg(F.array_sort(F.collect_list(F.struct("k", "p")))["p"].alias("first"))


def _lines(nodes: DataFrame, line) -> DataFrame:
    """(path, node_id, line) in order of paths: a node stands before what is below it, left before right."""
    return nodes.select(F.rpad(F.bin("node_id"), 64, " ").alias("path"), "node_id", line.alias("line")).orderBy("path")


def _brief():
    split = F.format_string("d%d < %s n=%d", "split_dim", F.col("split_value").cast("string"), "n_points")
    return F.when(F.col("is_leaf"), F.format_string("leaf n=%d", "n_points")).otherwise(split)


def drawing(index: Index, depth: int = 6) -> DataFrame:
    """Lines of the tree's top levels in order of paths, with the first five points of a leaf by id."""
    top = index.nodes.where(F.col("depth") <= depth)
    out = _lines(top, F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), _brief()))
    return out.join(_first_points(index).withColumnRenamed("leaf_id", "node_id"), "node_id", "left").select("path", "node_id", "line", "first").orderBy("path")


def compact(nodes: DataFrame) -> DataFrame:
    """A short line for each node."""
    return _lines(nodes, F.concat(F.col("node_id").cast("string"), F.lit(": "), _brief()))


def detailed(index: Index) -> DataFrame:
    """All that is known of each node: place, size, counter, bounds, and the first points of a leaf."""
    nodes = index.nodes.join(_first_points(index).withColumnRenamed("leaf_id", "node_id"), "node_id", "left")
    known = [
        F.format_string("node %d parent %s depth %d n=%d", "node_id", F.coalesce(F.col("parent_id").cast("string"), F.lit("none")), "depth", "n_points"),
        F.concat(F.lit("box "), F.array_join(F.zip_with("lo", "hi", lambda a, b: F.concat(F.lit("["), a.cast("string"), F.lit(" "), b.cast("string"), F.lit("]"))), " ")),
        F.when(F.col("is_leaf"), F.concat(F.lit("leaf "), F.array_join(F.coalesce("first", F.array().cast("array<string>")), "; "))).otherwise(
            F.format_string("split d%d < %s counter %d", "split_dim", F.col("split_value").cast("string"), "approx_counter")
        ),
    ]
    return _lines(nodes, F.concat_ws(" | ", *known))


def on_part(index: Index, buckets: DataFrame, part_id: int) -> DataFrame:
    """The nodes that one part has, with a short line each: subtrees of the buckets dealt to it (``buckets`` as of ``build_parts``)."""
    return compact(part_of_nodes(index.nodes, buckets).where(F.col("part_id") == part_id))


def memory(index: Index, n_parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What each part holds if nodes are placed with their replicas, and the totals."""
    n_parts = n_parts or index.config.n_parts
    points = index.nodes.where("node_id = 1").first()
    loads = load(placement(index.nodes, points.n_points if points else 0, n_parts, index.config.leaf_size), n_parts)
    return loads, load_totals(loads, n_parts)


def full(index: Index) -> DataFrame:
    """Each node in detail, and behind a leaf all of its points."""
    points = index.points.select(
        F.rpad(F.bin("leaf_id"), 64, " ").alias("path"), F.col("leaf_id").alias("node_id"),
        F.concat(F.lit("  point "), F.col("id").cast("string"), F.lit(" ("), F.concat_ws(",", *dims(index.points)), F.lit(")")).alias("line"), F.col("id").alias("at"),
    )
    return detailed(index).withColumn("at", F.lit(None).cast("long")).unionByName(points).orderBy("path", F.col("at").asc_nulls_first()).drop("at")


def show_style(index: Index, style: str, buckets: DataFrame | None = None, part_id: int = 0) -> DataFrame:
    """The report of one of nine styles."""
    made = {
        "compact": lambda: compact(index.nodes), "tree": lambda: drawing(index), "detailed": lambda: detailed(index), "validate": lambda: validate(index.nodes),
        "counters": lambda: counter_report(index.nodes), "stats": lambda: stats(index.nodes), "memory": lambda: memory(index)[0].orderBy("part_id"),
        "part": lambda: on_part(index, buckets, part_id), "full": lambda: full(index),
    }
    if style == "part" and buckets is None:
        raise ValueError("the index was not built over parts")
    return made[style]()


STYLES = ("compact", "tree", "detailed", "validate", "counters", "stats", "memory", "part", "full")


def metrics(spark: SparkSession) -> dict[str, int]:
    """Memory of this machine and the tasks that run at a time."""
    page = os.sysconf("SC_PAGE_SIZE")
    return {"ram": page * os.sysconf("SC_PHYS_PAGES"), "ram_free": page * os.sysconf("SC_AVPHYS_PAGES"), "slots": spark.sparkContext.defaultParallelism}

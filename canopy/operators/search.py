"""Point location, range, radius and nearest-neighbour search.

A table of nodes of bounded size is pulled to the queries: every executor gets it
and walks down it with arrays.  A larger one stays where it is, and a frontier of
(query, node) rows is pushed down it by equi-joins, a level at a time.  Either
way nothing is ever compared with all nodes or all points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canopy.functions.storage import release, settle
from canopy.operators.build import Index, depth_of
from canopy.sources.points import dims

#: Nodes that are pulled to the queries at most; they reach the driver and every executor.
PULL_NODES = 200_000
#: Pairs of a query and a node that a task holds at a time, about.
FRONTIER = 1 << 18


class Tree:
    """A table of nodes as arrays, in order of their ids."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r.node_id)
        self.ids = np.array([r.node_id for r in rows], np.int64)
        self.leaf = np.array([r.is_leaf for r in rows], bool)
        self.dim = np.array([r.split_dim or 0 for r in rows], np.int32)
        self.value = np.array([r.split_value if r.split_value is not None else 0.0 for r in rows], np.float64)
        self.size = np.array([r.n_points for r in rows], np.int64)
        self.lo, self.hi = np.array([r.lo for r in rows], np.float64), np.array([r.hi for r in rows], np.float64)
        self.child = np.stack([self._place(2 * self.ids), self._place(2 * self.ids + 1)])

    def _place(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def path(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, nodes) of each level of the way down; a value equal to a split goes right.  It ends where a child is missing."""
        own, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        while len(own):
            yield own, at
            inner = ~self.leaf[at]
            own, at = own[inner], at[inner]
            at = self.child[(x[own, self.dim[at]] >= self.value[at]).astype(np.int64), at]
            own, at = own[at >= 0], at[at >= 0]

    def locate(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each query, -1 if its place in the tree holds no points."""
        out = np.full(len(x), -1, np.int64)
        for own, at in self.path(x):
            out[own] = np.where(self.leaf[at], self.ids[at], -1)
        return out

    def spread(self, n: int, enters: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(queries, leaf ids) that ``enters`` (queries, nodes) leads to; the root is always entered."""
        own, at, out = np.arange(n), np.zeros(n, np.int64), []
        todo = [(own, at)]
        while todo:
            own, at = todo.pop()
            if len(own) > FRONTIER:
                half = len(own) // 2
                todo += [(own[:half], at[:half]), (own[half:], at[half:])]
                continue
            end = self.leaf[at]
            out.append((own[end], self.ids[at[end]]))
            own, at = own[~end], at[~end]
            if len(own):
                own, at = np.concatenate([own, own]), np.concatenate([self.child[0, at], self.child[1, at]])
                own, at = own[at >= 0], at[at >= 0]
                good = enters(own, at)
                if good.any():
                    todo.append((own[good], at[good]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2

    def within(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves that closed boxes meet."""
        return self.spread(len(low), lambda q, v: ((self.lo[v] <= high[q]) & (self.hi[v] >= low[q])).all(1))

    def near(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves at most ``bound`` away."""
        return self.spread(len(x), lambda q, v: _norm(np.maximum(0.0, np.maximum(self.lo[v] - x[q], x[q] - self.hi[v]))) <= bound[q])

    def bounds(self, x: np.ndarray, k: int) -> np.ndarray:
        """The distance within which each query surely has ``k`` points: to the farthest corner of a node on its path that holds so many."""
        out = np.full(len(x), np.inf)
        for own, at in self.path(x):
            enough = (self.size[at] >= k) | (self.ids[at] == 1)
            own, at = own[enough], at[enough]
            far = _norm(np.maximum(np.abs(x[own] - self.lo[at]), np.abs(self.hi[at] - x[own])))
            out[own] = np.minimum(out[own], far)
        return out


def _norm(x: np.ndarray) -> np.ndarray:
    """Lengths, the squares being added in the order of the columns as in SQL."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out = out + x[:, k] * x[:, k]
    return np.sqrt(out)


def pulled(index: Index, most: int | None = None) -> Tree | None:
    """The nodes of an index as arrays, or None if there are more than ``most`` or none."""
    most = PULL_NODES if most is None else most
    found = index.nodes.select("node_id", "is_leaf", "split_dim", "split_value", "n_points", "lo", "hi").limit(most + 1).collect() if most else []
    return Tree(found) if 0 < len(found) <= most else None


def _numbers(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in names], 1)


def _pull(tree: Tree, queries: DataFrame, added: str, work: Callable[[Tree, pa.RecordBatch], tuple[np.ndarray, list]]) -> DataFrame:
    """Rows of ``queries`` with further columns: ``work`` gives the rows to take and the columns."""
    shared = queries.sparkSession.sparkContext.broadcast(tree)
    schema = StructType([*queries.schema.fields, *StructType.fromDDL(added).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows, more = work(shared.value, b)
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows)).columns, *map(pa.array, more)], names=schema.names)

    return queries.mapInArrow(run, schema)


def walk(index: Index, queries: DataFrame, enters: Column) -> DataFrame:
    """(query columns, leaf_id): leaves whose path from the root satisfies ``enters``; the way that pushes queries to nodes.

    ``enters`` is a condition over the query's columns and a child's node_id, lo,
    hi, parent's split_dim and split_value (as s_dim, s_value) and ``side`` (0 or 1).
    Each level is written once, so that no level is worked out twice.
    """
    up = index.nodes.select(F.col("node_id").alias("p"), F.col("split_dim").alias("s_dim"), F.col("split_value").alias("s_value"))
    child = index.nodes.select("node_id", "parent_id", "is_leaf", "lo", "hi", F.pmod("node_id", F.lit(2)).alias("side"))
    steps = settle(child.join(up, F.col("parent_id") == F.col("p")).drop("p"), "steps")
    names = queries.columns
    root = index.nodes.where("node_id = 1").select("node_id", "is_leaf")
    cur = settle(queries.withColumn("at", F.lit(1).cast("long")).join(root.withColumnRenamed("node_id", "at"), "at").select(*names, "at", "is_leaf"), "walk")
    out = cur.where("is_leaf").select(*names, F.col("at").alias("leaf_id"))
    while not cur.where("not is_leaf").isEmpty():
        cur = cur.where("not is_leaf").select(*names, "at").join(steps, F.col("at") == F.col("parent_id")).where(enters)
        cur = settle(cur.select(*names, F.col("node_id").alias("at"), "is_leaf"), "walk")
        out = out.unionByName(cur.where("is_leaf").select(*names, F.col("at").alias("leaf_id")))
    release(steps)
    return out


def locate(index: Index, queries: DataFrame, most: int | None = None) -> DataFrame:
    """(id, d.., leaf_id, path_length): the leaf of each query; a value equal to a split goes right."""
    cols, tree = dims(queries), pulled(index, most)
    if tree is None:
        x = F.get(F.array(*cols), F.col("s_dim"))
        out = walk(index, queries, F.col("side") == (x >= F.col("s_value")).cast("long"))
    else:

        def find(t: Tree, b: pa.RecordBatch):
            leaf = t.locate(_numbers(b, cols))
            rows = np.flatnonzero(leaf >= 0)
            return rows, [leaf[rows]]

        out = _pull(tree, queries, "leaf_id long", find)
    return out.withColumn("path_length", depth_of(F.col("leaf_id")))


def in_box(points: DataFrame, box: list[tuple[float, float]]) -> DataFrame:
    """Points of one closed box; the conditions reach the scan."""
    for c, (low, high) in zip(dims(points), box, strict=True):
        points = points.where(F.col(c).between(F.lit(low), F.lit(high)))
    return points


def range_search(index: Index, boxes: DataFrame, most: int | None = None) -> DataFrame:
    """(box_id, id) of points in closed boxes; ``boxes`` has box_id and l0, h0, l1, h1, ..."""
    cols, tree = dims(index.points), pulled(index, most)
    meets = F.lit(True)
    inside = F.lit(True)
    for k, c in enumerate(cols):
        meets = meets & (F.get("lo", k) <= F.col(f"h{k}")) & (F.get("hi", k) >= F.col(f"l{k}"))
        inside = inside & F.col(c).between(F.col(f"l{k}"), F.col(f"h{k}"))
    if tree is None:
        found = walk(index, boxes, meets)
    else:
        low, high = [f"l{k}" for k in range(len(cols))], [f"h{k}" for k in range(len(cols))]

        def find(t: Tree, b: pa.RecordBatch):
            rows, leaves = t.within(_numbers(b, low), _numbers(b, high))
            return rows, [leaves]

        found = _pull(tree, boxes, "leaf_id long", find)
    return found.join(index.points, "leaf_id").where(inside).select("box_id", "id")


def _square(values: list[Column]) -> Column:
    out = F.lit(0.0)
    for v in values:
        out = out + v * v
    return out


def _distance(a: list[str], b: list[str]) -> Column:
    return F.sqrt(_square([F.col(x).cast("double") - F.col(y).cast("double") for x, y in zip(a, b, strict=True)]))


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(index: Index, queries: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest points, ties by id.

    The farthest corner of the smallest node on the query's path that holds k
    points bounds the distance; leaves nearer than the bound are searched.
    """
    cols, tree = dims(queries), pulled(index, most)
    q = queries.select(F.col("id").alias("query_id"), *[F.col(c).alias(f"q{n}") for n, c in enumerate(cols)])
    named = [f"q{n}" for n in range(len(cols))]
    if tree is None:
        reached = _reached(index, q, named, k)
    else:

        def find(t: Tree, b: pa.RecordBatch):
            x = _numbers(b, named)
            bound = t.bounds(x, k)
            rows, leaves = t.near(x, bound)
            return rows, [bound[rows], leaves]

        reached = _pull(tree, q, "bound double, leaf_id long", find)
    pairs = reached.join(index.points, "leaf_id").withColumn("distance", _distance(named, dims(index.points)))
    return _ranked(pairs.where(F.col("distance") <= F.col("bound")), k).select("query_id", "id", "distance", "rank")


def _reached(index: Index, q: DataFrame, named: list[str], k: int) -> DataFrame:
    """Queries with their bound and the leaves within it, by walks."""
    at = walk(index, q, F.col("side") == (F.get(F.array(*named), F.col("s_dim")) >= F.col("s_value")).cast("long"))
    path = at.withColumn("node_id", F.explode(F.transform(F.sequence(F.lit(0), depth_of(F.col("leaf_id"))), lambda i: F.call_function("shiftright", F.col("leaf_id"), i))))
    path = path.join(index.nodes.select("node_id", "n_points", "lo", "hi"), "node_id")
    far = [F.greatest(F.abs(F.col(c).cast("double") - F.get("lo", n).cast("double")), F.abs(F.get("hi", n).cast("double") - F.col(c).cast("double"))) for n, c in enumerate(named)]
    enough = (F.col("n_points") >= k) | (F.col("node_id") == 1)
    bound = settle(path.where(enough).groupBy("query_id", *named).agg(F.min(F.sqrt(_square(far))).alias("bound")), "bounds")
    near = [F.greatest(F.lit(0.0), F.get("lo", n).cast("double") - F.col(c).cast("double"), F.col(c).cast("double") - F.get("hi", n).cast("double")) for n, c in enumerate(named)]
    return walk(index, bound, F.sqrt(_square(near)) <= F.col("bound"))


def knn_by_scan(points: DataFrame, queries: DataFrame, k: int, block: int = 512) -> DataFrame:
    """The same without an index, for many dimensions: a stated set of queries against all rows, in blocks.

    Both tables have (id, v) with ``v`` an array.  Queries are numbered once and written, so that each is in one block; a block
    reaches the driver and every executor, and each partition keeps its own k best of a query before the shuffle.
    """
    spark = points.sparkSession
    numbered = settle(running(queries.select("id", "v").withColumn("one", F.lit(1).cast("long")), ["id"], "one", "nth"), "queries")
    total = numbered.count()
    out = None
    for start in range(0, max(total, 1), block):
        rows = numbered.where((F.col("nth") >= start) & (F.col("nth") < start + block)).select("id", "v").collect()
        shared = spark.sparkContext.broadcast((np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows], np.float64)))
        found = points.select("id", "v").mapInArrow(_best(shared, k), "query_id long, id long, distance double")
        out = found if out is None else out.unionByName(found)
    return _ranked(out, k).select("query_id", "id", "distance", "rank")


def _best(shared, k: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        best_d, best_i = np.full((len(qid), 0), np.inf), np.zeros((len(qid), 0), np.int64)
        for b in batches:
            if not b.num_rows or not len(qid):
                continue
            x = np.array(b.column(1).to_pylist(), np.float64)
            d = np.stack([np.sqrt(((x - v) ** 2).sum(1)) for v in q])
            d = np.concatenate([best_d, d], 1)
            i = np.concatenate([best_i, np.broadcast_to(b.column(0).to_numpy(), (len(qid), len(x)))], 1)
            order = np.lexsort((i, d))[:, :k]
            best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        n = best_d.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n)), pa.array(best_i.ravel()), pa.array(best_d.ravel())], names=["query_id", "id", "distance"])

    return work


def running(table: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``table`` with the sum of ``value`` over all rows before each, in the order of some columns.

    Rows are ranged once and written; sums of whole ranges are few (one for each
    partition), so that no task sees more than its range.
    """
    ranged = settle(table.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums, before = {}, 0
    for part, n in sorted(map(tuple, ranged.groupBy("_part").agg(F.sum(value)).collect())):
        sums[part], before = before, before + n
    first = table.sparkSession.createDataFrame([(p, int(n)) for p, n in sums.items()], "_part int, _first long")
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")
    return ranged.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + own).drop("_part", "_first")


#: Dimensions that are cut into a grid; the others are compared within its cells.
GRID = 3


def radius_pairs(points: DataFrame, radius: float, left: DataFrame | None = None) -> DataFrame:
    """(a, b, distance) of ordered pairs at most ``radius`` apart, each point with itself too.

    Points meet in the cells of a grid over the first dimensions: the left side looks into the cells around its own.
    """
    cols = dims(points)
    cells = [f"c{n}" for n in range(min(len(cols), GRID))]
    cell = [cell_of(F.col(c), radius).alias(name) for c, name in zip(cols, cells, strict=False)]
    right = points.select(F.col("id").alias("b"), *[F.col(c).alias(f"r{n}") for n, c in enumerate(cols)], *cell)
    own = (points if left is None else left).select(F.col("id").alias("a"), *[F.col(c).alias(f"l{n}") for n, c in enumerate(cols)], *cell)
    for c in cells:
        own = own.withColumn(c, F.explode(cells_around(F.col(c))))
    d = _distance([f"l{n}" for n in range(len(cols))], [f"r{n}" for n in range(len(cols))])
    return own.join(right, cells).withColumn("distance", d).where(F.col("distance") <= radius).select("a", "b", "distance")


def cell_of(value: Column, radius: float) -> Column:
    """The cell of a grid a trifle wider than ``radius``, as a DOUBLE that no coordinate makes overflow."""
    return F.rint(value.cast("double") / F.lit(radius * (1 + 2.0**-20)) - 0.5)


def cells_around(cell: Column) -> Column:
    """Cells in which values within the radius may be; beyond 2^32 a rounded quotient may be off by one."""
    wide = F.array(*[cell + s for s in (-2.0, -1.0, 0.0, 1.0, 2.0)])
    return F.array_distinct(F.when(F.abs(cell) < 2.0**32, F.array(*[cell + s for s in (-1.0, 0.0, 1.0)])).otherwise(wide))

"""Queries over the star-schema tables, one or more per operator of the index, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.config import Config
from canopy.operators import build as b
from canopy.operators import cluster, counters, density, diagnose, placement, search, update
from canopy.sources.points import as_points


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _l3(s, d):
    li = _t(s, d, "lineitem")
    key = F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return as_points(li, key, ["l_quantity", "l_extendedprice", "l_discount"])


def _p2(s, d):
    return as_points(_t(s, d, "part"), "p_partkey", ["p_size", "p_retailprice"])


def _c2(s, d):
    return as_points(_t(s, d, "customer"), "c_custkey", [F.col("c_acctbal") / 100, F.col("c_nationkey") * 4], "double")


P2 = "p AS (SELECT p_partkey AS id, CAST(p_size AS FLOAT) AS d0, CAST(p_retailprice AS FLOAT) AS d1 FROM part)"
L3 = "l AS (SELECT CAST(l_quantity AS FLOAT) AS d0, CAST(l_extendedprice AS FLOAT) AS d1, CAST(l_discount AS FLOAT) AS d2 FROM lineitem)"
C2 = "c AS (SELECT c_custkey AS id, c_acctbal / 100 AS d0, CAST(c_nationkey * 4 AS DOUBLE) AS d1 FROM customer)"
P2_ROWS = "SELECT p_partkey AS id, CAST(p_size AS FLOAT) AS d0, CAST(p_retailprice AS FLOAT) AS d1 FROM part"
L3_ROWS = "SELECT 0 AS id, CAST(l_quantity AS FLOAT) AS d0, CAST(l_extendedprice AS FLOAT) AS d1, CAST(l_discount AS FLOAT) AS d2 FROM lineitem"
O1_ROWS = "SELECT o_orderkey AS id, CAST(o_totalprice AS FLOAT) AS d0 FROM orders"


def tree_sql(rows: str, k: int) -> str:
    """The exact build in SQL: ``tree`` has a row per point and node on its path, ``nodes`` a row per node.

    A step takes the points of the nodes of the level before that have more than 32 points and a spread, and splits each at the
    value at offset n div 2 of its widest dimension, or at the next larger one if nothing is below.
    """
    cols = ", ".join(f"d{i}" for i in range(k))
    spans = ", ".join(f"max(d{i}) OVER g - min(d{i}) OVER g AS w{i}" for i in range(k))
    wide = f"greatest({', '.join(f'w{i}' for i in range(k))})" if k > 1 else "w0"
    value = " ".join(f"WHEN w{i} = wide THEN d{i}" for i in range(k))
    dim = " ".join(f"WHEN w{i} = wide THEN {i}" for i in range(k))
    return f"""tree AS (
  SELECT CAST(1 AS BIGINT) AS node_id, id, {cols}, CAST(NULL AS INT) AS p_dim, CAST(NULL AS FLOAT) AS p_cut FROM ({rows})
  UNION ALL
  SELECT 2 * node_id + CASE WHEN v >= cut THEN 1 ELSE 0 END, id, {cols}, dim, cut FROM (
    SELECT *, CASE WHEN median > low THEN median ELSE min(CASE WHEN v > median THEN v END) OVER (PARTITION BY node_id) END AS cut FROM (
      SELECT *, max(CASE WHEN nth = n // 2 + 1 THEN v END) OVER (PARTITION BY node_id) AS median, min(v) OVER (PARTITION BY node_id) AS low FROM (
        SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY v) AS nth FROM (
          SELECT *, CASE {value} END AS v, CASE {dim} END AS dim FROM (
            SELECT *, {wide} AS wide FROM (
              SELECT *, count(*) OVER g AS n, {spans} FROM tree WINDOW g AS (PARTITION BY node_id)))
          WHERE n > 32 AND wide > 0))))),
sizes AS (SELECT node_id, count(*) AS n FROM tree GROUP BY node_id),
cuts AS (SELECT node_id // 2 AS node_id, any_value(p_dim) AS dim, any_value(p_cut) AS cut FROM tree WHERE node_id > 1 GROUP BY node_id // 2),
nodes AS (
  SELECT s.node_id, s.n, c.cut IS NULL AS is_leaf, c.dim, c.cut, CAST(floor(log2(s.node_id)) AS INT) AS depth, l.n AS left_n, r.n AS right_n
  FROM sizes s LEFT JOIN cuts c USING (node_id) LEFT JOIN sizes l ON l.node_id = 2 * s.node_id LEFT JOIN sizes r ON r.node_id = 2 * s.node_id + 1)"""


P2_TREE, L3_TREE, O1_TREE = (f"WITH RECURSIVE {tree_sql(rows, k)} " for rows, k in ((P2_ROWS, 2), (L3_ROWS, 3), (O1_ROWS, 1)))
Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


BOX = "l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 20000 AND 40000 AND l_discount BETWEEN 0.05 AND 0.07"


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem WHERE {BOX}")
def range_report(s, d):
    li = _t(s, d, "lineitem").where(BOX)
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")


@query(f"SELECT count(*) AS n FROM lineitem WHERE {BOX}")
def range_count(s, d):
    pts = as_points(_t(s, d, "lineitem"), F.lit(0), ["l_quantity", "l_extendedprice", "l_discount"], "double", check=False)
    return search.in_box(pts, [(10, 20), (20000, 40000), (0.05, 0.07)]).agg(F.count("*").alias("n"))


@query(f"WITH {P2}, b AS (SELECT i AS box_id, CAST(i * 4 AS FLOAT) AS l0, CAST(i * 4 + 7 AS FLOAT) AS h0, CAST(900 + i * 10 AS FLOAT) AS l1, CAST(1000 + i * 10 AS FLOAT) AS h1 FROM range(0, 12) r(i)) SELECT box_id, id FROM b JOIN p ON d0 BETWEEN l0 AND h0 AND d1 BETWEEN l1 AND h1")
def range_multi_box(s, d):
    i = F.col("id")
    boxes = s.range(12).select(i.alias("box_id"), (i * 4).cast("float").alias("l0"), (i * 4 + 7).cast("float").alias("h0"), (900 + i * 10).cast("float").alias("l1"), (1000 + i * 10).cast("float").alias("h1"))
    return search.range_search(b.build_exact(_p2(s, d)), boxes)


@query(f"WITH {C2} SELECT x.id AS id, count(*) AS n FROM c x JOIN c y ON sqrt((x.d0 - y.d0) * (x.d0 - y.d0) + (x.d1 - y.d1) * (x.d1 - y.d1)) <= 3 GROUP BY x.id")
def radius_count(s, d):
    return density.radius_counts(_c2(s, d), 3.0)


@query("WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT q.id AS query_id, e.id, round(list_distance(q.v, e.v), 6) AS distance, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, e.v), e.id) AS rank FROM e q CROSS JOIN e WHERE q.id % 50 = 0) SELECT query_id, id, distance, rank FROM r WHERE rank <= 5")
def knn_embeddings(s, d):
    e = _t(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search.knn_by_scan(e, e.where("id % 50 = 0"), 5).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {P2}, r AS (SELECT q.id AS query_id, p.id, sqrt((q.d0::DOUBLE - p.d0) ** 2 + (q.d1::DOUBLE - p.d1) ** 2) AS dist FROM p q CROSS JOIN p WHERE q.id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM r) SELECT query_id, id, round(dist, 6) AS distance, rank FROM k WHERE rank <= 5")
def knn_part(s, d):
    pts = _p2(s, d)
    return search.knn(b.build_exact(pts), pts.where("id % 50 = 0"), 5).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


WIDE = f"WITH {L3}, w AS (SELECT count(*) AS n, max(d0) - min(d0) AS r0, max(d1) - min(d1) AS r1, max(d2) - min(d2) AS r2 FROM l), k AS (SELECT n, CASE WHEN r0 >= r1 AND r0 >= r2 THEN 0 WHEN r1 >= r2 THEN 1 ELSE 2 END AS split_dim FROM w), m AS (SELECT d1 AS split_value FROM (SELECT d1, row_number() OVER (ORDER BY d1) - 1 AS i, count(*) OVER () AS n FROM l) WHERE i = n // 2)"


def _root(s, d):
    pts = _l3(s, d).withColumn("g", F.lit(1))
    return pts, b.split_values(pts, b.widest(pts, ["g"]), ["g"])


@query(WIDE + " SELECT n, split_dim FROM k")
def split_dim(s, d):
    return b.widest(_l3(s, d).withColumn("g", F.lit(1)), ["g"]).select("n", "split_dim")


@query(WIDE + " SELECT split_dim, split_value FROM k, m")
def split_value(s, d):
    return _root(s, d)[1].select("split_dim", "split_value")


@query(WIDE + " SELECT CASE WHEN d1 < split_value THEN 0 ELSE 1 END AS side, count(*) AS n, min(d1) AS low, max(d1) AS high FROM l, m GROUP BY 1")
def partition_sides(s, d):
    pts, cut = _root(s, d)
    side = F.when(b._chosen(pts) < F.col("split_value"), 0).otherwise(1)
    return pts.join(cut.drop("n"), "g").groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.min("d1").alias("low"), F.max("d1").alias("high"))


@query(WIDE + " SELECT CASE WHEN d1 < split_value THEN CAST(2 AS BIGINT) ELSE 3 END AS node_id, count(*) AS n_points, min(d0) AS lo0, max(d1) AS hi1 FROM l, m GROUP BY 1")
def build_root_children(s, d):
    nodes = b.build_exact(_l3(s, d)).nodes.where("node_id in (2, 3)")
    return nodes.select("node_id", "n_points", F.get("lo", 0).alias("lo0"), F.get("hi", 1).alias("hi1"))


@query(L3_TREE + "SELECT n AS n_points, count(*) AS leaves FROM nodes WHERE is_leaf GROUP BY n")
def build_leaf_sizes(s, d):
    return b.build_exact(_l3(s, d)).nodes.where("is_leaf").groupBy("n_points").agg(F.count("*").alias("leaves"))


@query("SELECT count(*) AS points, TRUE AS small_leaves, TRUE AS deep FROM lineitem")
def build_sampled_points(s, d):
    nodes = b.build_sampled(_l3(s, d)).nodes.where("is_leaf")
    return nodes.agg(F.sum("n_points").alias("points"), (F.max(F.when(~F.col("degenerate"), F.col("n_points"))) <= 32).alias("small_leaves"), (F.max("depth") > 3).alias("deep"))


@query(L3_TREE + "SELECT count(*) FILTER (NOT is_leaf) AS internal, count(*) FILTER (is_leaf) AS leaves, CAST(sum(n) FILTER (is_leaf) AS BIGINT) AS points, min(depth) AS min_depth, max(depth) AS max_depth, avg(n) FILTER (is_leaf) AS avg_leaf, max(n) FILTER (is_leaf) AS max_leaf, avg(n) FILTER (NOT is_leaf) AS avg_counter, max(CASE WHEN node_id = 1 THEN least(left_n, right_n) / (left_n + right_n) END) AS root_balance FROM nodes")
def tree_stats(s, d):
    return diagnose.stats(b.build_exact(_l3(s, d)).nodes)


@query("SELECT count(*) AS located, CAST(0 AS BIGINT) AS wrong FROM part")
def leaf_locate(s, d):
    ix = b.build_exact(_p2(s, d))
    found = search.locate(ix, _p2(s, d)).join(ix.points.select("id", F.col("leaf_id").alias("own")), "id")
    return found.agg(F.count("*").alias("located"), F.sum((F.col("own") != F.col("leaf_id")).cast("long")).alias("wrong"))


#: A sketch with plain numbers, so that SQL can say it too.
SKETCH = [(1, 1, 950.0), (2, 0, 20.0), (3, 0, 30.0), (6, 1, 1000.0)]
BUCKET = "CASE WHEN d1 < 950 THEN CASE WHEN d0 < 20 THEN 4 ELSE 5 END ELSE CASE WHEN d0 < 30 THEN CASE WHEN d1 < 1000 THEN 12 ELSE 13 END ELSE 7 END END"


def _bucketed(s, d):
    return _p2(s, d).withColumn("bucket", b.route(SKETCH, ["d0", "d1"]))


@query(f"WITH {P2} SELECT CAST({BUCKET} AS BIGINT) AS bucket, count(*) AS n FROM p GROUP BY 1")
def bucket_counts(s, d):
    return _bucketed(s, d).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"WITH {P2}, k AS (SELECT CAST({BUCKET} AS BIGINT) AS bucket, id // 64 % 8 AS chunk, count(*) AS n FROM p GROUP BY ALL) SELECT bucket, chunk, n, CAST(coalesce(sum(n) OVER (ORDER BY bucket, chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM k")
def bucket_prefix_sum(s, d):
    return placement.prefix_sums(_bucketed(s, d).groupBy("bucket", F.expr("(id div 64) % 8").alias("chunk")).agg(F.count("*").alias("n")))


@query(f"WITH {P2} SELECT CAST({BUCKET} AS BIGINT) % 4 AS part_id, count(*) AS n FROM p GROUP BY 1")
def part_placement(s, d):
    return _bucketed(s, d).groupBy(F.pmod("bucket", F.lit(4)).alias("part_id")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS size, CASE WHEN o_orderkey BETWEEN 1 AND 2 THEN 0 WHEN o_orderkey > 2 AND o_orderkey <= 4 THEN 1 ELSE -1 END AS grp, CASE WHEN o_orderkey <= 32 THEN 0 WHEN o_orderkey < 10000 THEN 1 ELSE 0 END AS level FROM orders")
def node_group(s, d):
    size = F.col("o_orderkey")
    return _t(s, d, "orders").select(size.alias("size"), placement.node_group(size, placement.group_count(10000)).alias("grp"), placement.scatter_level(size, 10000).alias("level"))


@query("SELECT CASE WHEN o_orderkey <= 32 THEN 0 ELSE 1 END AS level, count(*) * CASE WHEN o_orderkey <= 32 THEN 1 ELSE 4 END AS copies FROM orders WHERE o_orderkey < 500 GROUP BY o_orderkey <= 32")
def scatter_level(s, d):
    nodes = _t(s, d, "orders").where("o_orderkey < 500").select(F.col("o_orderkey").alias("node_id"), F.col("o_orderkey").alias("n_points"))
    return placement.placement(nodes, 10000, 4).groupBy("level").agg(F.count("*").alias("copies"))


LOAD = P2_TREE + """, c AS (SELECT node_id, n, unnest(CASE WHEN n > 32 AND n < 2000 THEN range(0, 8) ELSE [0] END) AS replica FROM nodes),
k AS (SELECT *, CAST(CAST('0x' || substr(md5(node_id || ':' || replica), 1, 8) AS BIGINT) % 8 AS INT) AS part_id FROM c),
per AS (SELECT part_id, count(*) AS nodes, count(*) FILTER (replica > 0) AS replicas, CAST(sum(n) AS BIGINT) AS points, CAST(sum(n * 12 + 64) AS BIGINT) AS bytes FROM k GROUP BY part_id)"""


@query(LOAD + " SELECT part_id, nodes, replicas, points, bytes, nodes * 8 / (SELECT count(*) FROM k) AS load FROM per")
def placement_load(s, d):
    nodes = b.build_exact(_p2(s, d)).nodes
    return placement.load(placement.placement(nodes, 2000, 8), 8)


@query(LOAD + " SELECT CAST(sum(nodes) AS BIGINT) AS nodes, CAST(sum(replicas) AS BIGINT) AS replicas, CAST(sum(points) AS BIGINT) AS points, CAST(sum(bytes) AS BIGINT) AS bytes, sum(nodes) / 8 AS avg_nodes, sum(bytes) / 8 AS avg_bytes FROM per")
def placement_totals(s, d):
    return placement.load_totals(placement_load(s, d), 8)


@query(LOAD + ", f AS (SELECT node_id, min_by(part_id, replica) AS part_id FROM k GROUP BY node_id) SELECT o_orderkey AS node_id, coalesce(part_id, CAST(CAST('0x' || substr(md5(o_orderkey || ':0'), 1, 8) AS BIGINT) % 8 AS INT)) AS part_id FROM orders LEFT JOIN f ON o_orderkey = f.node_id")
def find_part(s, d):
    """The part of each order's key taken as a node: registered for nodes of the index, hashed for others."""
    placed = placement.placement(b.build_exact(_p2(s, d)).nodes, 2000, 8)
    return placement.find_parts(_t(s, d, "orders").select(F.col("o_orderkey").alias("node_id")), placed, 8)


@query(LOAD + " SELECT node_id, replica, part_id, CAST(coalesce(sum(n * 12) OVER (PARTITION BY part_id ORDER BY node_id, replica ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM k")
def placement_offsets(s, d):
    placed = placement.placement(b.build_exact(_p2(s, d)).nodes, 2000, 8)
    return placement.offsets(placed).select("node_id", "replica", "part_id", "offset")


@query(f"WITH {P2} SELECT count(*) AS points, TRUE AS small_leaves, TRUE AS spread, CAST(0 AS BIGINT) AS astray FROM p")
def build_parts(s, d):
    """The partitioned build over 8 parts: all points, leaves within the limit, several parts, and no node apart from its bucket's part."""
    index, buckets = b.build_parts(_p2(s, d), Config(dimensions=2, n_parts=8, sketch_height=6))
    nodes = b.part_of_nodes(index.nodes, buckets)
    astray = nodes.where("is_leaf and part_id is null").agg(F.count("*").alias("astray"))
    leaves = nodes.where("is_leaf").agg(F.sum("n_points").alias("points"), (F.max(F.when(~F.col("degenerate"), F.col("n_points"))) <= 32).alias("small_leaves"), (F.countDistinct("part_id") > 1).alias("spread"))
    return leaves.crossJoin(astray)


@query(f"WITH {P2} SELECT CAST({BUCKET} AS BIGINT) AS bucket, CAST({BUCKET} % 4 AS INT) AS part_id, count(*) AS n, min(id) AS first_id FROM p GROUP BY 1, 2")
def sketch_assign(s, d):
    return b.assign(_p2(s, d), SKETCH, 4).groupBy("bucket", "part_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(P2_TREE + "SELECT t.id, t.node_id AS leaf_id, CAST(floor(log2(t.node_id)) AS INT) AS path_length FROM tree t SEMI JOIN (SELECT node_id FROM nodes WHERE is_leaf) l USING (node_id)")
def locate_pushed(s, d):
    """The leaf of each part, by pushing the points down the table of nodes."""
    return search.locate(b.build_exact(_p2(s, d)), _p2(s, d), most=0).select("id", "leaf_id", "path_length")


@query(P2_TREE + "SELECT t.id, t.node_id AS leaf_id, CAST(floor(log2(t.node_id)) AS INT) AS path_length FROM tree t SEMI JOIN (SELECT node_id FROM nodes WHERE is_leaf) l USING (node_id)")
def locate_pulled(s, d):
    """The same, by pulling the nodes to the points."""
    return search.locate(b.build_exact(_p2(s, d)), _p2(s, d)).select("id", "leaf_id", "path_length")


@query("SELECT part_id, count(*) AS n, min(id) AS first_id FROM (SELECT p_partkey AS id, ntile(64) OVER (ORDER BY p_partkey) - 1 AS part_id FROM part) GROUP BY part_id")
def even_deal(s, d):
    return placement.even_deal(_p2(s, d), 64).groupBy("part_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("SELECT o_custkey AS node_id, count(*) AS n, count(*) > CASE o_custkey % 5 WHEN 0 THEN 130 WHEN 1 THEN 14 WHEN 2 THEN 6 WHEN 3 THEN 4 ELSE 8 END AS pull FROM orders GROUP BY o_custkey")
def push_or_pull(s, d):
    seen = _t(s, d, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(F.count("*").alias("n"))
    return seen.select("node_id", "n", placement.pulls(F.col("n"), F.pmod("node_id", F.lit(5)), F.lit(False), placement.thresholds(64)).alias("pull"))


def _grown(s, d):
    pts = _p2(s, d)
    return update.insert(b.build_exact(pts), pts.where("id < 150").withColumn("id", F.col("id") + 1000000))


@query(f"WITH {P2} SELECT id, d0, d1 FROM p UNION ALL SELECT id + 1000000, d0, d1 FROM p WHERE id < 150")
def insert_batch(s, d):
    return _grown(s, d).points.select("id", "d0", "d1")


@query("SELECT count(*) + count(*) FILTER (p_partkey < 150) AS points, TRUE AS small_leaves, CAST(0 AS BIGINT) AS invalid FROM part")
def insert_counts(s, d):
    nodes = _grown(s, d).nodes
    leaves = nodes.where("is_leaf").agg(F.sum("n_points").alias("points"), (F.max(F.when(~F.col("degenerate"), F.col("n_points"))) <= 32).alias("small_leaves"))
    return leaves.crossJoin(diagnose.validate(nodes).select((F.col("invalid_parents") + F.col("childless") + F.col("self_cycles")).alias("invalid")))


@query(f"WITH {P2}, g AS (SELECT *, row_number() OVER (PARTITION BY d0, d1 ORDER BY id) AS i FROM p), r AS (SELECT d0, d1, count(*) AS k FROM p WHERE id % 10 = 3 GROUP BY ALL) SELECT g.id, g.d0, g.d1 FROM g LEFT JOIN r USING (d0, d1) WHERE i > coalesce(k, 0)")
def delete_batch(s, d):
    pts = _p2(s, d)
    return update.delete(b.build_exact(pts), pts.where("id % 10 = 3"))[0].points.select("id", "d0", "d1")


@query(f"WITH {C2}, f AS (SELECT id, CAST(d0 AS FLOAT) AS d0, CAST(d1 AS FLOAT) AS d1 FROM c), r AS (SELECT d0, d1, count(*) AS k, min(id) AS request FROM f WHERE id % 7 = 0 GROUP BY ALL), m AS (SELECT request, f.id, k, row_number() OVER (PARTITION BY request ORDER BY f.id) AS i FROM r JOIN f USING (d0, d1)) SELECT request, id FROM m WHERE i <= k")
def delete_tolerance(s, d):
    pts = as_points(_c2(s, d), "id", ["d0", "d1"])
    return update.matched(pts, pts.where("id % 7 = 0"))


@query("SELECT CAST(0 AS BIGINT) AS removed, count(*) AS points FROM part")
def delete_missing(s, d):
    pts = _p2(s, d)
    ix, n = update.delete(b.build_exact(pts), pts.where("id < 20").withColumn("d1", F.col("d1") + F.lit(5e6).cast("float")))
    return ix.points.agg(F.lit(n).cast("long").alias("removed"), F.count("*").alias("points"))


TREE = "t AS (SELECT o_orderkey AS node_id, o_custkey AS n FROM orders WHERE o_orderkey BETWEEN 1 AND 1023), k AS (SELECT a.node_id, a.n AS c, l.n AS left_n, r.n AS right_n FROM t a LEFT JOIN t l ON l.node_id = 2 * a.node_id LEFT JOIN t r ON r.node_id = 2 * a.node_id + 1 WHERE a.node_id < 512)"


def _tree(s, d):
    t = _t(s, d, "orders").where("o_orderkey between 1 and 1023").select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").alias("n_points"))
    leaf = F.col("node_id") >= 512
    return t.select("node_id", F.when(F.col("node_id") > 1, F.shiftright("node_id", 1)).alias("parent_id"), leaf.alias("is_leaf"), "n_points", F.when(~leaf, F.col("n_points")).alias("approx_counter"))


@query(f"WITH {TREE} SELECT node_id, left_n, right_n, (left_n IS NULL OR right_n IS NULL OR greatest(left_n, right_n) > 3 * least(left_n, right_n)) AS violates FROM k")
def balance_violations(s, d):
    return counters.violations(_tree(s, d))


@query(f"WITH {TREE}, x AS (SELECT node_id, c, coalesce(left_n, 0) + coalesce(right_n, 0) AS t FROM k) SELECT node_id, round(c / nullif(t, 0)::DOUBLE, 9) AS ratio, CASE WHEN t > 0 THEN c / t::DOUBLE BETWEEN 0.5 AND 2 ELSE c = 0 END AS consistent FROM x")
def counter_ratio(s, d):
    return counters.consistency(_tree(s, d)).select("node_id", F.round("ratio", 9).alias("ratio"), "consistent")


@query("SELECT o_custkey AS value, CAST(CASE WHEN o_custkey <= 0 THEN 0 ELSE floor(2 * o_custkey / log2(10000)) END AS BIGINT) AS step FROM orders")
def counter_step(s, d):
    return _t(s, d, "orders").select(F.col("o_custkey").alias("value"), counters.increment(F.col("o_custkey"), F.lit(10000)).alias("step"))


@query(f"WITH {TREE}, w AS (SELECT 512 + c_custkey % 512 AS leaf_id, count(*) AS w FROM customer GROUP BY 1), u AS (SELECT leaf_id // CAST(2 ** i AS BIGINT) AS node_id, sum(w) AS delta FROM w, range(0, 10) r(i) GROUP BY 1) SELECT node_id, CAST(greatest(n + coalesce(delta, 0), 1) AS BIGINT) AS counter FROM t LEFT JOIN u USING (node_id) WHERE node_id < 512")
def counter_propagation(s, d):
    moves = _t(s, d, "customer").select((F.col("c_custkey") % 512 + 512).alias("leaf_id"), F.lit(1).cast("long").alias("weight"))
    return counters.propagate(_tree(s, d), moves).where("not is_leaf").select("node_id", F.col("approx_counter").alias("counter"))


@query("SELECT count(*) AS visited, CAST(0 AS BIGINT) AS self_cycles, CAST(0 AS BIGINT) AS invalid_parents, CAST(0 AS BIGINT) AS childless FROM orders WHERE o_orderkey BETWEEN 1 AND 1023")
def validate_structure(s, d):
    return diagnose.validate(_tree(s, d))


@query(P2_TREE + "SELECT count(*) AS checked, count(*) FILTER (n / (left_n + right_n) NOT BETWEEN 0.5 AND 2) AS inconsistent, min(n / (left_n + right_n)) AS min_ratio, max(n / (left_n + right_n)) AS max_ratio, count(*) FILTER (n = 0) AS zero_counters FROM nodes WHERE NOT is_leaf")
def counter_report(s, d):
    return diagnose.counter_report(b.build_exact(_p2(s, d)).nodes)


BRIEF = "CASE WHEN is_leaf THEN 'leaf n=' || n ELSE 'd' || dim || ' < ' || cut || ' n=' || n END"


@query(P2_TREE + f"SELECT rpad(bin(node_id), 64, ' ') AS path, node_id, repeat('  ', depth) || {BRIEF} AS line FROM nodes WHERE depth <= 6")
def tree_drawing(s, d):
    return diagnose.drawing(b.build_exact(_p2(s, d))).select("path", "node_id", "line")


@query(P2_TREE + f"SELECT rpad(bin(node_id), 64, ' ') AS path, node_id, node_id || ': ' || {BRIEF} AS line FROM nodes")
def tree_compact(s, d):
    return diagnose.compact(b.build_exact(_p2(s, d)).nodes)


FIRST = "f AS (SELECT node_id, string_agg(d0 || ',' || d1, '; ' ORDER BY id) AS first FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY id) AS k FROM tree) WHERE k <= 5 GROUP BY node_id), x AS (SELECT node_id, '[' || min(d0) || ' ' || max(d0) || '] [' || min(d1) || ' ' || max(d1) || ']' AS box FROM tree GROUP BY node_id)"
DETAIL = "'node ' || node_id || ' parent ' || CASE WHEN node_id > 1 THEN CAST(node_id // 2 AS VARCHAR) ELSE 'none' END || ' depth ' || depth || ' n=' || n || ' | box ' || box || ' | ' || CASE WHEN is_leaf THEN 'leaf ' || first ELSE 'split d' || dim || ' < ' || cut || ' counter ' || n END"


@query(P2_TREE + f", {FIRST} SELECT rpad(bin(node_id), 64, ' ') AS path, node_id, {DETAIL} AS line FROM nodes JOIN f USING (node_id) JOIN x USING (node_id)")
def tree_detailed(s, d):
    return diagnose.detailed(b.build_exact(_p2(s, d)))


@query(P2_TREE + f", {FIRST} SELECT rpad(bin(node_id), 64, ' ') AS path, node_id, {DETAIL} AS line FROM nodes JOIN f USING (node_id) JOIN x USING (node_id) UNION ALL SELECT rpad(bin(node_id), 64, ' '), node_id, '  point ' || id || ' (' || d0 || ',' || d1 || ')' FROM tree SEMI JOIN (SELECT node_id FROM nodes WHERE is_leaf) l USING (node_id)")
def tree_full(s, d):
    return diagnose.full(b.build_exact(_p2(s, d)))


@query(P2_TREE + f", a AS (SELECT node_id, unnest([node_id // CAST(2 ** i AS BIGINT) FOR i IN range(0, 20)]) AS up FROM nodes) SELECT rpad(bin(node_id), 64, ' ') AS path, node_id, node_id || ': ' || {BRIEF} AS line FROM nodes SEMI JOIN (SELECT node_id FROM a WHERE up IN (5, 7)) o USING (node_id)")
def tree_on_part(s, d):
    """The nodes of one part of an index whose nodes 4 to 7 are dealt over two parts by their number."""
    buckets = s.createDataFrame([(4, 0), (5, 1), (6, 0), (7, 1)], "bucket long, part_id int")
    return diagnose.on_part(b.build_exact(_p2(s, d)), buckets, 1)


NEAR = f"{C2}, e AS (SELECT x.id AS a, y.id AS b FROM c x JOIN c y ON sqrt((x.d0 - y.d0) * (x.d0 - y.d0) + (x.d1 - y.d1) * (x.d1 - y.d1)) <= 3), core AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 5), ce AS (SELECT e.* FROM e SEMI JOIN core c1 ON e.a = c1.a SEMI JOIN core c2 ON e.b = c2.a)"
DB = f"WITH RECURSIVE {NEAR}, r AS (SELECT a, a AS root FROM core UNION SELECT ce.b, r.root FROM r JOIN ce ON ce.a = r.a), cl AS (SELECT a, min(root) AS cluster FROM r GROUP BY a), lab AS (SELECT c.id, CASE WHEN cl.a IS NOT NULL THEN 'core' WHEN bo.cluster IS NOT NULL THEN 'border' ELSE 'noise' END AS kind, coalesce(cl.cluster, bo.cluster, -1) AS cluster FROM c LEFT JOIN cl ON cl.a = c.id LEFT JOIN (SELECT e.a, min(cl.cluster) AS cluster FROM e JOIN cl ON e.b = cl.a GROUP BY e.a) bo ON bo.a = c.id)"


@query(DB + " SELECT id, kind, cluster FROM lab")
def dbscan_labels(s, d):
    return cluster.dbscan(_c2(s, d), 3.0, 5)


@query(DB + " SELECT kind, count(*) AS n, count(DISTINCT cluster) AS clusters FROM lab GROUP BY kind")
def dbscan_summary(s, d):
    return cluster.dbscan(_c2(s, d), 3.0, 5).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("clusters"))


DPC = f"{C2}, rho AS (SELECT x.id, x.d0, x.d1, count(*) - 1 AS rho FROM c x JOIN c y ON sqrt((x.d0 - y.d0) * (x.d0 - y.d0) + (x.d1 - y.d1) * (x.d1 - y.d1)) <= 3 GROUP BY ALL), m AS (SELECT x.id, min(struct_pack(dist := sqrt((x.d0 - y.d0) * (x.d0 - y.d0) + (x.d1 - y.d1) * (x.d1 - y.d1)), id := y.id)) AS m FROM rho x JOIN rho y ON y.rho > x.rho OR (y.rho = x.rho AND y.id < x.id) GROUP BY x.id), pk AS (SELECT rho.id, rho.rho, m.m.dist AS delta, m.m.id AS parent FROM rho LEFT JOIN m USING (id))"


@query(f"WITH {DPC} SELECT id, rho, round(delta, 6) AS delta, parent FROM pk")
def dpc_rho_delta(s, d):
    return cluster.density_peaks(_c2(s, d), 3.0).select("id", "rho", F.round("delta", 6).alias("delta"), "parent")


@query(f"WITH RECURSIVE {DPC}, f AS (SELECT id, id AS label FROM pk WHERE parent IS NULL OR (rho > 2 AND delta > 6) UNION ALL SELECT pk.id, f.label FROM f JOIN pk ON pk.parent = f.id WHERE NOT (pk.rho > 2 AND pk.delta > 6)) SELECT id, label FROM f")
def dpc_labels(s, d):
    return cluster.peak_labels(cluster.density_peaks(_c2(s, d), 3.0), 2, 6.0)


# The queries above that hold to 1,023 orders, 500 orders or a few ids have SQL that says so. Those below do the same work on whole
# tables: the nodes of a built index, all orders, and batches of a tenth of the points. Tests hold those without SQL to plain Python.


@query(P2_TREE + "SELECT node_id, left_n, right_n, greatest(left_n, right_n) > 3 * least(left_n, right_n) AS violates FROM nodes WHERE NOT is_leaf")
def built_balance(s, d):
    return counters.violations(b.build_exact(_p2(s, d)).nodes)


@query(P2_TREE + "SELECT node_id, round(n / (left_n + right_n), 9) AS ratio, n / (left_n + right_n) BETWEEN 0.5 AND 2 AS consistent FROM nodes WHERE NOT is_leaf")
def built_counter_ratio(s, d):
    return counters.consistency(b.build_exact(_p2(s, d)).nodes).select("node_id", F.round("ratio", 9).alias("ratio"), "consistent")


@query(P2_TREE + "SELECT node_id, 2 * n AS counter FROM nodes WHERE NOT is_leaf")
def built_propagation(s, d):
    """Each point moves the counters above its leaf by one."""
    ix = b.build_exact(_p2(s, d))
    moves = ix.points.select("leaf_id", F.lit(1).cast("long").alias("weight"))
    return counters.propagate(ix.nodes, moves).where("not is_leaf").select("node_id", F.col("approx_counter").alias("counter"))


@query(P2_TREE + "SELECT count(*) AS visited, CAST(0 AS BIGINT) AS self_cycles, count(*) FILTER (node_id > 1 AND node_id // 2 NOT IN (SELECT node_id FROM nodes)) AS invalid_parents, count(*) FILTER (NOT is_leaf AND left_n IS NULL AND right_n IS NULL) AS childless FROM nodes")
def built_structure(s, d):
    return diagnose.validate(b.build_exact(_p2(s, d)).nodes)


@query("SELECT CASE WHEN o_orderkey > 32 AND o_orderkey < 10000 THEN 1 ELSE 0 END AS level, sum(CASE WHEN o_orderkey > 32 AND o_orderkey < 10000 THEN 4 ELSE 1 END)::BIGINT AS copies FROM orders GROUP BY 1")
def scatter_level_all(s, d):
    nodes = _t(s, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_orderkey").alias("n_points"))
    return placement.placement(nodes, 10000, 4).groupBy("level").agg(F.count("*").alias("copies"))


def _grown_tenth(s, d):
    pts = _p2(s, d)
    return update.insert(b.build_exact(pts), pts.where("id % 10 = 3").withColumn("id", -F.col("id")))


@query(f"WITH {P2} SELECT id, d0, d1 FROM p UNION ALL SELECT -id, d0, d1 FROM p WHERE id % 10 = 3")
def insert_tenth(s, d):
    return _grown_tenth(s, d).points.select("id", "d0", "d1")


@query("SELECT count(*) + count(*) FILTER (p_partkey % 10 = 3) AS points, CAST(0 AS BIGINT) AS invalid FROM part")
def insert_tenth_counts(s, d):
    nodes = _grown_tenth(s, d).nodes
    checks = diagnose.validate(nodes).select((F.col("invalid_parents") + F.col("childless") + F.col("self_cycles")).alias("invalid"))
    return nodes.where("is_leaf").agg(F.sum("n_points").alias("points")).crossJoin(checks)


@query("SELECT CAST(0 AS BIGINT) AS removed, count(*) AS points FROM part")
def delete_missing_tenth(s, d):
    pts = _p2(s, d)
    ix, n = update.delete(b.build_exact(pts), pts.where("id % 10 = 3").withColumn("d1", F.col("d1") + F.lit(5e6).cast("float")))
    return ix.points.agg(F.lit(n).cast("long").alias("removed"), F.count("*").alias("points"))


@query(P2_TREE + ", v AS (SELECT node_id FROM nodes WHERE NOT is_leaf AND greatest(left_n, right_n) * 10 > 11 * least(left_n, right_n)), a AS (SELECT node_id AS leaf_id, unnest([node_id // CAST(2 ** i AS BIGINT) FOR i IN range(0, 20)]) AS up FROM nodes WHERE is_leaf) SELECT leaf_id, max(up) AS node_id FROM a JOIN v ON up = v.node_id GROUP BY leaf_id")
def first_imbalance(s, d):
    """The nearest node above each leaf whose sides differ by more than a tenth."""
    return counters.first_imbalance(b.build_exact(_p2(s, d)).nodes, 0.1)


@query(O1_TREE + "SELECT node_id, depth, is_leaf, n AS n_points, dim AS split_dim, cut AS split_value FROM nodes")
def build_one_dimension(s, d):
    """The whole table of nodes over one dimension."""
    return b.build_exact(as_points(_t(s, d, "orders"), "o_orderkey", ["o_totalprice"])).nodes.select("node_id", "depth", "is_leaf", "n_points", "split_dim", "split_value")


FAR = "g AS (SELECT o_orderkey AS id, CAST((o_totalprice - 250000) * 4e9 AS FLOAT) AS d0, CAST(o_custkey * 1e11 AS FLOAT) AS d1 FROM orders)"


def _far(s, d):
    """Orders as points over the default range of the generator, 1e15 either way."""
    return as_points(_t(s, d, "orders"), "o_orderkey", [(F.col("o_totalprice") - 250000) * 4e9, F.col("o_custkey") * 1e11])


@query(f"WITH {FAR}, k AS (SELECT *, row_number() OVER (PARTITION BY d0, d1 ORDER BY id) AS i FROM g), r AS (SELECT d0, d1, count(*) AS n FROM g WHERE id % 10 = 3 GROUP BY ALL) SELECT k.id FROM k LEFT JOIN r USING (d0, d1) WHERE i > coalesce(n, 0)")
def delete_far(s, d):
    """A tenth of the points, far from the origin, is deleted again."""
    pts = _far(s, d)
    return update.delete(b.build_exact(pts), pts.where("id % 10 = 3"))[0].points.select("id")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(S)

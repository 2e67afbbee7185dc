import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy import queries as q
from canopy.config import Config
from canopy.operators import build as b
from canopy.operators import cluster, counters, diagnose, placement, search, update
from canopy.plans.cli import Shell
from canopy.sources import points as p
from canopy.streaming.updates import LiveIndex, follow

DATA = "/root/testdata/sf0.001"


def make(spark, rows, k=2):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, " + ", ".join(f"d{n} float" for n in range(k)))


def sizes(ix):
    r = ix.nodes.agg(F.sum((~F.col("is_leaf")).cast("int")), F.sum(F.col("is_leaf").cast("int")), F.max("depth"), F.max(F.when(F.col("is_leaf"), F.col("n_points")))).first()
    return tuple(r)


def clean(ix):
    v = diagnose.validate(ix.nodes).first()
    wrong = search.locate(ix, ix.points.drop("leaf_id")).join(ix.points.select("id", F.col("leaf_id").alias("own")), "id").where("own <> leaf_id")
    return v.invalid_parents == v.childless == v.self_cycles == 0 and wrong.isEmpty()


@pytest.mark.parametrize("local", [20_000, 500])
@pytest.mark.parametrize(("cols", "want"), [(["l_quantity", "l_extendedprice", "l_discount"], (255, 256, 8, 24)), (["l_quantity", "l_discount", "l_tax"], (264, 265, 10, 32))])
def test_golden_trees(spark, local, cols, want):
    li = spark.read.parquet(f"{DATA}/lineitem.parquet")
    pts = p.as_points(li, F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"), cols)
    assert sizes(b.build_exact(pts, local_points=local)) == want


@pytest.mark.parametrize(("rows", "want"), [([(1, 1)], (0, 1, 0, 1)), ([(i, 0) for i in range(32)], (0, 1, 0, 32)), ([(i, 0) for i in range(33)], (1, 2, 1, 17)), ([(3, 3)] * 100, (0, 1, 0, 100)), ([(0, 0)] * 60 + [(1, 0)] * 3, (1, 2, 1, 60))])
def test_edges(spark, rows, want):
    ix = b.build_exact(make(spark, rows), local_points=1)
    assert sizes(ix) == want and clean(ix)
    assert (want[3] > 32) == ix.nodes.agg(F.max("degenerate")).first()[0]


def test_no_points_and_bad_points(spark):
    assert b.build_exact(make(spark, [])).nodes.isEmpty()
    for bad in (None, float("nan")):
        df = spark.createDataFrame([(1, bad)], "id long, x double")
        with pytest.raises(Exception, match="null or NaN"):
            p.as_points(df, "id", ["x"]).collect()


@pytest.mark.parametrize("most", [None, 0])
def test_searches_match_brute_force(spark, most):
    """With the nodes pulled to the queries, and with queries pushed down the table of nodes."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 60, (400, 2)).astype(np.float32)
    ix = b.build_sampled(make(spark, x))
    assert clean(ix)
    got = {(r.query_id, r["rank"]): r.id for r in search.knn(ix, make(spark, x[:20]), 7, most).collect()}
    for i in range(20):
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(1))
        assert [got[i, k] for k in range(1, 8)] == np.lexsort((np.arange(400), d))[:7].tolist()
    assert search.knn(ix, make(spark, x[:1]), 500, most).count() == 400
    boxes = spark.createDataFrame([(0, 10.0, 20.0, 5.0, 40.0)], "box_id long, l0 float, h0 float, l1 float, h1 float")
    inside = {i for i, (a, c) in enumerate(x) if 10 <= a <= 20 and 5 <= c <= 40}
    assert {r.id for r in search.range_search(ix, boxes, most).collect()} == inside == {r.id for r in search.in_box(ix.points, [(10, 20), (5, 40)]).collect()}
    own = {r.id: r.leaf_id for r in ix.points.collect()}
    assert {r.id: r.leaf_id for r in search.locate(ix, make(spark, x), most).collect()} == own
    pairs = {(r.a, r.b) for r in search.radius_pairs(make(spark, x), 2.5).collect()}
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2))
    assert pairs == set(zip(*map(np.ndarray.tolist, np.nonzero(d <= 2.5)), strict=True))


def test_updates(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2)).astype(np.float32)
    ix = b.build_exact(make(spark, x))
    more = make(spark, np.concatenate([x[:5], rng.normal(5, 0.01, (200, 2))])).withColumn("id", F.col("id") + 1000)
    grown = update.insert(ix, more)
    assert clean(grown) and grown.points.count() == 505 and not grown.nodes.where("is_leaf and n_points > 32").count()
    assert not counters.violations(grown.nodes).where("violates").count()
    back, n = update.delete(grown, more)
    assert n == 205 and clean(back) and back.points.count() == 300
    twice = make(spark, [x[0], x[0], x[0], (99, 99)])
    less, n = update.delete(grown, twice)
    assert n == 2 and less.points.count() == 503
    none, n = update.delete(ix, make(spark, x))
    assert n == 300 and none.nodes.isEmpty() and update.insert(none, make(spark, x)).points.count() == 300


def test_counters(spark):
    row = spark.range(1).select(*[counters.increment(F.lit(v), F.lit(10000)).alias(f"v{v}") for v in (0, 6, 7, 13, 100)]).first()
    assert tuple(row) == (0, 0, 1, 1, 15)
    assert placement.thresholds(64) == [130, 14, 6, 4] and placement.thresholds(4) == [10, 6] and placement.thresholds(1) == []
    moved = spark.range(2000).select(counters.approximate(F.lit(100).cast("long"), F.lit(10000), True).alias("v")).groupBy("v").count().collect()
    assert {r.v for r in moved} == {100, 115}


def test_files(spark, tmp_path):
    pts = make(spark, [(1, 2), (3, 4.5)])
    path = str(tmp_path / "x.bin")
    p.write_binary(pts, path)
    assert p.read_binary(spark, path, 2, 2).orderBy("id").collect() == pts.orderBy("id").collect()
    with pytest.raises(ValueError, match="holds"):
        p.read_binary(spark, path, 3)
    (tmp_path / "short.bin").write_bytes(struct.pack("<II", 9, 2) + b"\0" * 8)
    with pytest.raises(Exception, match="shorter"):
        p.read_binary(spark, str(tmp_path / "short.bin")).collect()
    (tmp_path / "t.txt").write_text("# x\n1 2\n 3 4.5 \n")
    assert [tuple(r) for r in p.read_text(spark, str(tmp_path / "t.txt")).collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.5)]
    ix = b.build_exact(pts)
    ix.save(str(tmp_path / "ix"))
    assert b.Index.load(spark, str(tmp_path / "ix")).points.count() == 2
    assert p.first_points(pts, 1).collect()[0].d0 == "1.0000"
    (tmp_path / ".env").write_text("# c\nleafWrapThreshold = 8\nother=1\nalpha=1.5 # x\n")
    cfg = Config.load(str(tmp_path / ".env"))
    assert (cfg.leaf_size, cfg.alpha, cfg.chunk_size) == (8, 1.5, 64) and Config.load("/no/file") == Config()
    with pytest.raises(ValueError, match="sketch_height"):
        Config(chunk_size=32)


def test_shell_and_stream(spark, tmp_path):
    pts = p.generate(spark, 100, 2, 0, 1)
    path = str(tmp_path / "x.bin")
    p.write_binary(pts, path)
    sh = Shell(spark)
    assert sh.run(f"build {path}").first().points == 100
    assert sh.run("K 3 0.5 0.5").count() == 3 and sh.run("r 0 1 0 1").count() == 100
    assert sh.run(f"d {path}") == "100 points removed" and sh.run("quit") is None and "knn" in sh.run("h")
    live = LiveIndex(b.build_exact(pts))
    rows = [("insert", 500, 0.5, 0.5), ("insert", 501, 2.0, 2.0), ("delete", 1, 2.0, 2.0)]
    spark.createDataFrame(rows, "op string, id long, d0 float, d1 float").write.parquet(str(tmp_path / "in"))
    s = follow(live, spark.readStream.schema("op string, id long, d0 float, d1 float").parquet(str(tmp_path / "in")), str(tmp_path / "cp"))
    s.processAllAvailable()
    s.stop()
    assert live.index.points.count() == 101


def test_queries_have_sql():
    assert set(q.oracle_sql()) <= set(q.queries()) and len(q.queries()) >= 35


def test_whole_table_queries(spark):
    """Over all parts and orders, held to counts of the points of the index's leaves."""
    ix = b.build_exact(q._p2(spark, DATA))
    n, leaves = {}, {r.node_id for r in ix.nodes.where("is_leaf").collect()}
    for r in ix.points.select("leaf_id").collect():
        k = r.leaf_id
        while k:
            n[k], k = n.get(k, 0) + 1, k >> 1
    inner = set(n) - leaves
    parts = spark.read.parquet(f"{DATA}/part.parquet").count()
    keys = [r[0] for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey").collect()]
    assert n[1] == parts

    def run(name):
        return {r[0]: tuple(r[1:]) for r in q.queries()[name](spark, DATA).collect()}

    sides = {k: (n[2 * k], n[2 * k + 1]) for k in inner}
    assert run("built_balance") == {k: (x, y, max(x, y) > 3 * min(x, y)) for k, (x, y) in sides.items()}
    assert run("built_counter_ratio") == {k: (1.0, True) for k in inner}
    assert run("built_propagation") == {k: (2 * n[k],) for k in inner}
    assert run("built_structure") == {len(n): (0, 0, 0)}
    one = sum(32 < k < 10000 for k in keys)
    assert run("scatter_level_all") == {0: (len(keys) - one,), 1: (4 * one,)}
    tenth = sum(r.id % 10 == 3 for r in ix.points.select("id").collect())
    assert run("insert_tenth_counts") == {parts + tenth: (0,)} and len(run("insert_tenth")) == parts + tenth
    assert run("delete_missing_tenth") == {0: (parts,)}


def test_medians_by_histograms(spark):
    """Brackets narrowed to a few points: the value at n div 2, or the next larger one if that is the least."""
    rng = np.random.default_rng(9)
    groups = [rng.normal(size=501), rng.integers(0, 3, 400), np.repeat([5.0], 50), np.r_[np.zeros(300), 1.0, 2.0], np.r_[rng.random(99), 1e30], rng.integers(-4, 4, 64) * 1e15]
    rows = [(i, g, float(v), 0.0) for g, x in enumerate(groups) for i, v in enumerate(x.astype(np.float32))]
    pts = spark.createDataFrame(rows, "id long, g long, d0 float, d1 float")
    got = {r.g: r.split_value for r in b.split_values(pts, b.widest(pts, ["g"]), ["g"], ranked=7).collect()}
    for g, x in enumerate(groups):
        x = np.sort(x.astype(np.float32))
        cut = x[len(x) // 2]
        above = x[x > x[0]]
        assert got[g] == (cut if cut > x[0] else above[0] if len(above) else None), g


def test_sampled_buckets_over_the_limit_are_split(spark, monkeypatch):
    monkeypatch.setattr(b, "LOCAL_VALUES", 120)
    x = np.random.default_rng(2).normal(size=(900, 2))
    ix = b.build_sampled(make(spark, x), Config(dimensions=2, sketch_height=1, chunk_size=2))
    assert clean(ix) and sizes(ix)[3] <= 32 and ix.points.count() == 900


def serial_delete(points, requests, tolerance):
    """Requests of equal coordinates share a name; each takes equal points by id, then those within reach, smallest ids first."""
    wanted = {}
    for i, c in sorted(requests):
        wanted.setdefault(c, []).append(i)
    left, out, more = dict(sorted(points)), set(), []
    for c, ids in sorted(wanted.items(), key=lambda x: x[1][0]):
        same = [p for p, x in left.items() if x == c][: len(ids)]
        out |= {(ids[0], p) for p in same}
        for p in same:
            del left[p]
        more.append((ids[0], c, len(ids) - len(same)))
    for name, c, n in more:
        near = [p for p, x in left.items() if all(abs(np.float32(a) - np.float32(v)) <= tolerance for a, v in zip(x, c, strict=True))][:n]
        out |= {(name, p) for p in near}
        for p in near:
            del left[p]
    return out


def test_deletion_within_the_tolerance(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 3, (120, 2)) * 1e-3
    stored = (base + rng.integers(-3, 4, (120, 2)) * 4e-7).astype(np.float32)
    asked = (base[:80] + rng.integers(-3, 4, (80, 2)) * 4e-7).astype(np.float32)
    got = {(r.request, r.id) for r in update.matched(make(spark, stored), make(spark, asked)).collect()}
    as_list = lambda x: [(i, tuple(map(float, r))) for i, r in enumerate(x)]
    assert got == serial_delete(as_list(stored), as_list(asked), 1e-6) and len(got) > 60
    # a chain: the second request gets the point that the first one leaves
    chain = {(r.request, r.id) for r in update.matched(make(spark, [(0.5, 0), (0.5000015, 0)]), make(spark, [(0.5000008, 0), (0.4999994, 0)])).collect()}
    assert chain == {(0, 0)} or chain == {(0, 1), (1, 0)}


def test_far_points(spark):
    """The default range of the generator, 1e15 either way."""
    pts = p.generate(spark, 300, 3)
    ix = b.build_exact(pts)
    left, n = update.delete(ix, pts.where("id < 100"))
    assert n == 100 and left.points.count() == 200 and clean(left)
    assert search.radius_pairs(pts, 1e-3).count() == 300


def test_a_batch_leaves_most_files_alone(spark):
    x = np.random.default_rng(1).normal(size=(2000, 2))
    ix = b.build_exact(make(spark, x))
    old = set(ix.points.inputFiles())
    grown = update.insert(ix, make(spark, [(0.1, 0.1)]).withColumn("id", F.lit(9999).cast("long")))
    assert old <= set(grown.points.inputFiles()) and grown.points.count() == 2001 and grown.pending == 1
    for k in range(update.COMPACT - 1):
        grown = update.insert(grown, make(spark, [(0.2, k)]).withColumn("id", F.lit(10_000 + k).cast("long")))
    assert grown.pending == 0 and not old & set(grown.points.inputFiles()) and grown.points.count() == 2000 + update.COMPACT and clean(grown)


def test_places_without_points(spark):
    """A sketch may have a side that no point falls to; a point that comes there makes a leaf of it."""
    ix = b._from_sketch(make(spark, [(i, 0) for i in range(40)]), [(1, 0, 20.0), (3, 1, 5.0)], Config(dimensions=2))
    assert clean(ix) and not ix.nodes.where("node_id = 7").count()
    nodes = update.insert(ix, make(spark, [(30, 9)]).withColumn("id", F.lit(77).cast("long")))
    assert nodes.points.count() == 41 and clean(nodes)


def test_parts_and_reports(spark, capsys, monkeypatch):
    pts = p.generate(spark, 3000, 2, 0, 1)
    ix, buckets = b.build_parts(pts, Config(dimensions=2, n_parts=4, sketch_height=6))
    assert clean(ix) and buckets.agg(F.sum("n")).first()[0] == 3000 and {r.part_id for r in buckets.collect()} <= set(range(4))
    shown = sum(diagnose.on_part(ix, buckets, k).count() for k in range(4))
    above = b.part_of_nodes(ix.nodes, buckets).where("part_id is null").count()
    assert shown + above == ix.nodes.count()
    for style in diagnose.STYLES:
        assert diagnose.show_style(ix, style, buckets).count() > 0, style
    assert diagnose.full(ix).count() == ix.nodes.count() + 3000
    loads, totals = diagnose.memory(ix)
    assert totals.first().nodes == sum(r.nodes for r in loads.collect()) and totals.first().avg_bytes > 0
    with pytest.raises(ValueError, match="parts"):
        diagnose.show_style(ix, "part")


def test_running_sums_and_even_deal(spark):
    rows = spark.range(103).withColumn("v", (F.col("id") * 7 % 5).cast("long"))
    got = {r.id: r.before for r in search.running(rows, ["id"], "v", "before").collect()}
    assert got == {i: sum(k * 7 % 5 for k in range(i)) for i in range(103)}
    for n in (1, 7, 103, 200):
        dealt = [r.part_id for r in placement.even_deal(rows, n).orderBy("id").collect()]
        want = [k for k in range(n) for _ in range(103 // n + (k < 103 % n))]
        assert dealt == want


def test_random_update_of_the_lowest_node(spark):
    ix = b.build_exact(make(spark, [(i, 0) for i in range(200)]))
    before = {r.node_id: r.approx_counter for r in ix.nodes.where("not is_leaf").collect()}
    leaf = ix.nodes.where("is_leaf").agg(F.min("node_id")).first()[0]
    moves = spark.createDataFrame([(leaf, 5)], "leaf_id long, weight long")
    exact = {r.node_id: r.approx_counter for r in counters.propagate(ix.nodes, moves).where("not is_leaf").collect()}
    assert exact == {k: v + 5 * (leaf >> (leaf.bit_length() - k.bit_length()) == k) for k, v in before.items()}
    some = {r.node_id: r.approx_counter for r in counters.propagate(ix.nodes, moves, "random", 200).where("not is_leaf").collect()}
    low = leaf >> 1
    step = int(1 / (np.log2(200) / (2 * before[low])))
    assert some[low] in (before[low], before[low] + step) and {k: v for k, v in some.items() if k != low} == {k: v for k, v in exact.items() if k != low}


def brute_dbscan(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = d.sum(1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.array([min(label[j] for j in np.flatnonzero(d[i] & core)) if core[i] else -1 for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    border = [min([label[j] for j in np.flatnonzero(d[i] & core)], default=-1) for i in range(len(x))]
    return [(i, "core" if core[i] else "border" if border[i] >= 0 else "noise", int(border[i])) for i in range(len(x))]


@pytest.mark.parametrize("scale", [1.0, 1e12])
def test_clusters_match_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.4, (40, 2)) for c in (0, 3, 3.9)] + [np.zeros((30, 2)), rng.uniform(-5, 9, (40, 2))]).astype(np.float32) * np.float32(scale)
    pts, wide = make(spark, x), x.astype(float)
    got = sorted(map(tuple, cluster.dbscan(pts, 0.5 * scale, 5).collect()))
    assert got == brute_dbscan(wide, 0.5 * scale, 5)
    d = np.sqrt(((wide[:, None] - wide[None]) ** 2).sum(2))
    rho = (d <= 0.5 * scale).sum(1) - 1
    for scan in (0, 1, 512):
        for r in cluster.density_peaks(pts, 0.5 * scale, scan=max(scan, 1)).collect():
            denser = [(d[r.id, j], j) for j in range(len(x)) if (rho[j], -j) > (rho[r.id], -r.id)]
            assert r.rho == rho[r.id] and (r.parent == min(denser)[1] if denser else r.parent is None)


def test_ranges_of_files(spark, tmp_path):
    pts = p.generate(spark, 1000, 3, 0, 1)
    path = str(tmp_path / "x.bin")
    p.write_binary(pts, path, piece=100)
    assert p.read_binary(spark, path, piece=200).orderBy("id").collect() == pts.orderBy("id").collect()
    (tmp_path / "t.txt").write_text("# c\n" + "".join(f"{i} {i / 2}\n" if i % 9 else f"{i} {i / 2}\n\n# x\n" for i in range(300)))
    assert [tuple(r) for r in p.read_text(spark, str(tmp_path / "t.txt")).orderBy("id").collect()] == [(i, float(i), i / 2) for i in range(300)]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    path, schema = str(tmp_path / "live"), "op string, id long, d0 float, d1 float"
    live = LiveIndex(b.build_exact(make(spark, [(0, 0), (1, 1)])), path)
    assert LiveIndex.open(spark, path).applied == -1
    change = spark.createDataFrame([("insert", 9, 5.0, 5.0)], schema)
    for epoch in range(3):
        live.apply(change.withColumn("id", F.lit(9 + epoch).cast("long")), epoch)
    again = LiveIndex.open(spark, path)
    again.apply(change, 2)  # it was applied before
    assert again.applied == 2 and again.index.points.count() == 5 and clean(again.index)


def test_prompt(spark, tmp_path, monkeypatch, capsys):
    from canopy.plans import cli

    path = str(tmp_path / "x.bin")
    p.write_binary(p.generate(spark, 200, 2, 0, 1), path)
    (tmp_path / ".env").write_text("leafWrapThreshold=10\nnPim=4\n")
    sh = Shell(spark)
    with pytest.raises(ValueError, match="build"):
        sh.run("knn 2 0.5 0.5")
    sh.run(f"config load {tmp_path / '.env'}")
    assert sh.run(f"build {path} -m exact").first().max_leaf <= 10
    assert sh.run(f"build {path} -p").first().points == 200 and sh.run("info part 1").count() and sh.run("info totals").first().nodes
    monkeypatch.setattr("sys.stdin", iter(["knn 1 1\n", "nonsense\n", "info stats\n"]))
    cli.main()  # ends with its input, and errors do not end it
    assert "max_leaf" not in capsys.readouterr().out


def test_release(spark):
    from canopy.functions.storage import release, settle

    t = settle(spark.range(5), "x")
    release(t, spark.range(3))
    with pytest.raises(Exception, match="(?i)not exist|not found|FILE_NOT_EXIST"):
        t.collect()


def test_a_settled_table_leaves_no_shuffle(spark):
    """The files of the shuffles of a table that has been written are deleted with no help of the garbage collector."""
    import glob
    import time

    from canopy.functions.storage import TIDY, settle

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    before, was = set(glob.glob(f"{folder}/*/shuffle_*")), spark.conf.get(TIDY, None)
    table = settle(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "tidy")
    for _ in range(50):
        if not (left := set(glob.glob(f"{folder}/*/shuffle_*")) - before):
            break
        time.sleep(0.1)
    assert table.count() == 7 and not left and spark.conf.get(TIDY, None) == was

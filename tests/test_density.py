"""Counting, clustering and peaks over an index: against brute force, and where pairs are far too many to be made."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy import queries as q
from canopy.operators import cluster, density, graph

from .test_index import brute_dbscan


def doubles(spark, x):
    k = x.shape[1]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"d{n} double" for n in range(k)))


def brute_peaks(x, dc):
    d = np.zeros((len(x), len(x)))
    for k in range(x.shape[1]):
        d = d + (x[:, None, k] - x[None, :, k]) ** 2
    d = np.sqrt(d)
    n = (d <= dc).sum(1)
    out = []
    for i in range(len(x)):
        best = min(((d[i, j], j) for j in range(len(x)) if (n[j], -j) > (n[i], -i)), default=(None, None))
        out.append((i, int(n[i]) - 1, best[0], best[1]))
    return out


@pytest.mark.parametrize("k", [1, 2, 4])
def test_against_brute_force(spark, k, monkeypatch):
    """Values that FLOAT cannot tell apart, equal points, outliers in leaves of dense ones, distances that equal the radius."""
    monkeypatch.setattr(density, "QUERIES", 64)
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(0, 0.4, (150, k)), 3 + rng.integers(0, 5, (60, k)) / 4, np.zeros((40, k)), rng.uniform(-9, 9, (60, k)), 7 + rng.normal(0, 1e-9, (30, k)), np.full((2, k), 1e-200)])
    pts = doubles(spark, x).repartition(3)
    want = brute_peaks(x, 0.5)
    assert sorted(map(tuple, density.radius_counts(pts, 0.5).collect())) == [(i, n + 1) for i, n, _, _ in want]
    assert sorted(map(tuple, cluster.density_peaks(pts, 0.5, 4).collect())) == want
    d = sum((x[:, None, j] - x[None, :, j]) ** 2 for j in range(k))
    assert (np.sqrt(d) <= 0.5).any()
    for least in (1, 5, 60):
        assert sorted(map(tuple, cluster.dbscan(pts, 0.5, least).collect())) == brute_dbscan(x, 0.5, least)


def test_no_points(spark):
    none = spark.createDataFrame([], "id long, d0 double, d1 double")
    assert density.radius_counts(none, 1.0).isEmpty() and cluster.dbscan(none, 1.0, 2).isEmpty() and cluster.density_peaks(none, 1.0).isEmpty()


def line(spark, n):
    """Points at 0, 1, .. n / 2 - 1, each twice."""
    return spark.range(n).select("id", F.floor(F.col("id") / 2).cast("double").alias("d0"), F.lit(0.0).alias("d1"))


def test_more_pairs_than_can_be_made(spark):
    """Each of 60,000 points has up to 40,000 neighbours: 2 billion pairs."""
    n, r = 60_000, 10_000
    got = density.radius_counts(line(spark, n), float(r))
    place = F.floor(F.col("id") / 2)
    want = 2 * (F.least(F.lit(r), place) + F.least(F.lit(r), F.lit(n // 2 - 1) - place) + 1)
    assert got.count() == n and got.where(F.col("n") != want).isEmpty()


@pytest.mark.parametrize("nodes", [100_000, 64])
def test_leaves_grow_when_nodes_are_many(spark, monkeypatch, nodes):
    sites = density.sites_of(line(spark, 4000))
    index = density.SiteTree(sites, nodes=nodes)
    assert len(index.tree.ids) <= nodes and index.sites.count() == 2000


def test_clusters_of_many_pairs(spark, tmp_path):
    """60,000 points on a line are one cluster, also when it is the table of customers that the queries read."""
    got = cluster.dbscan(line(spark, 60_000), 10_000.0, 5)
    assert [tuple(r) for r in got.groupBy("kind", "cluster").count().collect()] == [("core", 0, 60_000)]
    i = F.col("id")
    spark.range(40_000).select(i.alias("c_custkey"), (i % 200).cast("double").alias("c_acctbal"), F.lit(1).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    assert [tuple(r) for r in q.Q["dbscan_summary"](spark, str(tmp_path)).collect()] == [("core", 40_000, 1)]


def test_peaks_of_many_pairs(spark, tmp_path):
    """Customers at 200 places, all within the radius of each other: the smallest id is the only centre."""
    i = F.col("id")
    spark.range(40_000).select(i.alias("c_custkey"), (i % 200).cast("double").alias("c_acctbal"), F.lit(1).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    got = q.Q["dpc_rho_delta"](spark, str(tmp_path))
    # all are equally dense, so a point follows the smallest id at its place, and that one the nearest place with a smaller id
    want = F.when(i == 0, None).when(i < 200, i - 1).otherwise(i % 200)
    assert got.count() == 40_000 and got.where((F.col("rho") != 39_999) | ~F.col("parent").eqNullSafe(want)).isEmpty()
    labels = q.Q["dpc_labels"](spark, str(tmp_path)).groupBy("label").count().collect()
    assert [tuple(r) for r in labels] == [(0, 40_000)]


@pytest.mark.parametrize("followed", [1 << 21, 0])
def test_long_chains_of_parents(spark, monkeypatch, followed):
    """3,000 points in one chain and 500 in another: the labels are one table where they fit, and the rounds give the same."""
    monkeypatch.setattr(cluster, "FOLLOWED", followed)
    written, settle = [], cluster.settle
    monkeypatch.setattr(cluster, "settle", lambda df, tag: (written.append(tag), settle(df, tag))[1])
    i = F.col("id")
    peaks = spark.range(3500).select((i * 7 - 900).alias("id"), F.lit(9).alias("rho"), F.lit(1.0).alias("delta"), F.when((i != 0) & (i != 3000), i * 7 - 907).alias("parent"))
    got = cluster.peak_labels(peaks, 2, 6.0)
    assert got.dtypes == [("id", "bigint"), ("label", "bigint")]
    assert sorted(map(tuple, got.groupBy("label").count().collect())) == [(-900, 3000), (20100, 500)]
    assert cluster.peak_labels(peaks.limit(0), 2, 6.0).isEmpty()
    assert followed == 0 or written == ["labels", "labels"]


@pytest.mark.parametrize("links", [1 << 19, 0])
def test_clusters_with_one_index_and_links_in_memory(spark, monkeypatch, links):
    """Where all points are core the index of the counts serves again, and few links take no rounds; the results are those of the rounds."""
    monkeypatch.setattr(density, "LINKS", links)
    built, build, rounds, settle = [], density.build_exact, [], graph.settle
    monkeypatch.setattr(density, "build_exact", lambda *a: (built.append(1), build(*a))[1])
    monkeypatch.setattr(graph, "settle", lambda df, tag: (rounds.append(tag), settle(df, tag))[1])
    x = np.stack([np.concatenate([np.arange(600) / 4, 500 + np.arange(300) / 4]), np.zeros(900)], 1)
    got = cluster.dbscan(doubles(spark, x), 1.0, 2)
    assert sorted(map(tuple, got.groupBy("kind", "cluster").count().collect())) == [("core", 0, 600), ("core", 600, 300)]
    assert len(built) == 1 and (len(rounds) <= 2 if links else len(rounds) > 2)
    x = np.concatenate([x, [[1000.0, 0.0], [-0.9, 0.0]]])
    assert sorted(map(tuple, cluster.dbscan(doubles(spark, x), 1.0, 6).collect())) == brute_dbscan(x, 1.0, 6)


def test_components_in_memory(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(a) + int(b)) for a, b in zip(rng.integers(-500, 500, 300), rng.integers(-2, 3, 300), strict=True)]
    df = spark.createDataFrame(edges + [(10_000 + i, 10_001 + i) for i in range(400)], "u long, v long")
    got = graph.components(df, in_memory=1 << 19)
    assert got.dtypes == [("u", "bigint"), ("root", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.components(df).collect()))

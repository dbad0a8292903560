"""Clusters that grow, centroids that move, percentiles and synthetic vectors: against plain models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore import tables
from lodestore.operators import mutate, stats, topology
from lodestore.sources import datasets
from lodestore.types import CENTROIDS


@pytest.mark.parametrize(("metric", "new", "merge", "cap"), [("l2", 3.0, float("inf"), 12), ("cosine", 0.4, 0.1, 6), ("ip", -0.5, float("inf"), 5), ("l2", 1e9, float("inf"), 4)])
def test_growing_in_tasks_is_the_ordered_loop(spark, metric, new, merge, cap):
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(80, 4)), 3).astype(np.float32)
    table = [(0, [0.5, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 1.0])]
    homes, moved, counts = topology.grow_online([np.array(c) for _, c in table], [3, 0], x.astype(float), metric, new, merge, cap)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(80)], "id long, vector array<float>").repartition(3)
    placed, centroids, live = topology.grow(rows, spark.createDataFrame(table, CENTROIDS), spark.createDataFrame([(0, 3)], "cluster_id int, live long"), "id", metric, new, merge, cap)
    assert [p["cluster_id"] for p in placed.orderBy("id").collect()] == homes
    got = centroids.orderBy("cluster_id").collect()
    assert np.allclose([c["centroid"] for c in got], moved, atol=1e-5)
    assert [c["live"] for c in live.orderBy("cluster_id").collect()] == counts


def test_growing_from_nothing(spark):
    rows = spark.createDataFrame([("b", [1.0]), ("a", [5.0]), ("c", None)], "ext_id string, vector array<float>")
    placed, centroids, _ = topology.grow(rows, spark.createDataFrame([], CENTROIDS), spark.createDataFrame([], "cluster_id int, live long"), "ext_id", "l2", 1.0, cap=3)
    assert {r["ext_id"]: r["cluster_id"] for r in placed.collect()} == {"a": 0, "b": 1, "c": None}
    assert {r["cluster_id"]: r["centroid"] for r in centroids.collect()} == {0: [5.0], 1: [1.0]}


def test_kept_rows_are_placed_once(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(60)], "id long, vector array<float>")
    start = spark.createDataFrame([], CENTROIDS), spark.createDataFrame([], "cluster_id int, live long"), "id", "l2", 4.0, float("inf"), 5
    kept = []
    got = topology.grow(rows, *start, keep=lambda placed: kept.append(tables.cut(placed)) or kept[-1])
    assert len(kept) == 1 and all("ArrowEvalPython" not in df._jdf.queryExecution().optimizedPlan().toString() for df in got)
    for a, b, key in zip(got, topology.grow(rows, *start), ("id", "cluster_id", "cluster_id"), strict=True):
        assert a.orderBy(key).collect() == b.orderBy(key).collect()


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_percentiles_are_exact(spark, n):
    r = np.random.default_rng(n)
    x = np.round(r.exponential(size=n), 1)
    rows = [("a", float(v)) for v in x] + [("b", None), (None, 2.0), ("c", 1.0)] + [("c", 3.0)] * 50
    got = {g["kind"]: g for g in stats.latency_summary(spark.createDataFrame(rows, "kind string, seconds double")).collect()}
    for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
        assert got["a"][name] == pytest.approx(np.quantile(x * 1000, p))
    assert (got["b"]["n"], got["b"]["p50"], got[None]["p99"], got["c"]["p50"]) == (0, None, 2000.0, 3000.0)


def test_synthetic_vectors_do_not_depend_on_tasks(spark):
    one = {r["ext_id"]: r["vector"] for r in datasets.synthetic(spark, 300, 8).collect()}
    two = {r["ext_id"]: r["vector"] for r in datasets.synthetic(spark, 300, 8).repartition(7).collect()}
    x = np.array(list(one.values()))
    assert one == two and abs(x.mean()) < 0.1 and abs(x.std() - 1) < 0.1


def test_first_and_latest_rows(spark):
    rows = spark.createDataFrame([(1, None, "n"), (1, 5, "five"), (1, 3, "three"), (2, None, None)], "k int, at int, v string")
    assert {r["k"]: r["v"] for r in mutate.latest(rows, "k", "at").collect()} == {1: "five", 2: None}
    assert {r["k"]: r["v"] for r in mutate.first(rows, "k", "at").collect()} == {1: "n", 2: None}
    assert mutate.first(rows.where(F.col("k") > 5), "k", "at").count() == 0

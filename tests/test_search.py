"""Search, clusters and levels, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.functions import metrics
from lodestore.operators import search, topology

R = np.random.default_rng(4)
X = R.normal(size=(300, 8))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, vector array<float>").repartition(5).persist()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(i, [float(v) for v in X[i]]) for i in range(6)], "query_id long, vector array<float>")


def best(metric, k, keep=None):
    x = X.astype(np.float32).astype(float)
    keep = np.arange(len(x)) if keep is None else keep
    out = {}
    for q in range(6):
        s = x[keep] @ x[q]
        if metric == "cosine":
            s = s / (np.linalg.norm(x[keep], axis=1) * np.linalg.norm(x[q]))
        if metric == "l2":
            s = -np.linalg.norm(x[keep] - x[q], axis=1)
        out[q] = [int(keep[i]) for i in np.lexsort((keep, -s))[:k]]
    return out


def lists(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_exact(rows, asked, metric):
    assert lists(search.search(rows, asked, 7, metric)) == best(metric, 7)
    assert lists(search.search_expr(rows, asked, 7, metric)) == best(metric, 7)


def test_expressions_find_for_queries_of_all_blocks(rows, asked, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    assert lists(search.search_expr(rows, asked, 7, "l2")) == best("l2", 7)
    assert search.search_expr(rows, asked.limit(0), 7, "l2").count() == 0


def test_limits(spark, rows, asked):
    assert search.search(rows, asked, 0).count() == 0 and search.search(rows, asked, -1).count() == 0
    assert search.search(rows.where("id < 3"), asked, 10).count() == 18
    ties = spark.createDataFrame([(7, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [float("nan"), 1.0]), (10, None), (11, [1.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<float>")
    assert lists(search.search(ties, q, 5, "ip")) == {0: [2, 7]}
    assert search.search(ties.limit(0), q, 5).count() == 0


def test_string_ids_and_zero_vectors(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0])], "id string, vector array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    got = [(r["id"], round(r["score"], 6)) for r in search.search(rows, q, 2, "cosine").orderBy("rank").collect()]
    assert got == [("b", 1.0), ("a", 0.0)]


def test_all_probes_equal_exact_and_recall_grows(rows, asked):
    table = topology.train(rows, "l2", 20)
    placed = search.assign(rows, table, "l2")
    assert lists(search.search_probes(placed, table, asked, 7, 0, "l2")) == best("l2", 7)
    assert lists(search.search_probes(placed, table, asked, 7, topology.nlist(table), "l2")) == best("l2", 7)
    true = best("l2", 7)
    recall = [sum(len(set(true[q]) & set(ids)) for q, ids in lists(search.search_probes(placed, table, asked, 7, n, "l2")).items()) for n in (1, 3, 8)]
    assert recall == sorted(recall) and all(lists(search.search_probes(placed, table, asked, 7, 1, "l2"))[q][0] == q for q in range(6))


def test_chosen_clusters(rows, asked):
    table = topology.train(rows, "l2", 60)
    placed = search.assign(rows, table, "l2").persist()
    keep = np.array(sorted(r["id"] for r in placed.where("cluster_id in (0, 2)").collect()))
    assert lists(search.search_on(placed, asked, [0, 2], 4, "l2")) == best("l2", 4, keep)


def test_levels(rows, asked):
    fresh, settled = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    even = np.arange(0, 300, 2)
    assert lists(search.search_levels(fresh, settled, asked, 4, 1e9, "l2")) == best("l2", 4, even)
    assert lists(search.search_levels(fresh, settled, asked, 4, -1.0, "l2")) == best("l2", 4)
    assert lists(search.search_levels(fresh.limit(0), settled, asked, 4, 1e9, "l2")) == best("l2", 4, even + 1)


def test_delete_nearest(rows, asked):
    left, gone = search.delete_nearest(rows, asked, 3, "l2")
    want = {i for ids in best("l2", 3).values() for i in ids}
    assert {r["id"] for r in gone.collect()} == want and left.count() == 300 - len(want)


def test_assignment_ties_and_wrong_lengths(spark):
    table = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0])], "cluster_id int, centroid array<float>")
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0])], "id long, vector array<float>")
    assert {r["id"]: r["cluster_id"] for r in search.assign(rows, table).collect()} == {0: 1, 1: None}


def test_online_clusters():
    batch = [[0.0, 0.0], [10.0, 0.0], [10.5, 0.0], [0.2, 0.0]]
    homes, moved, live = topology.grow_online([], [], batch, "l2", 4.0, cap=8)
    assert homes == [0, 1, 1, 0] and live == [2, 2] and moved[1].tolist() == [10.25, 0.0]
    assert topology.grow_online([np.zeros(2)], [0], batch, "l2", 4.0, cap=1)[0] == [0, 0, 0, 0]


def test_centroids(spark):
    table = topology.zero_centroids(spark, 3, 2)
    table, new = topology.add_cluster(table, [1.0, 2.0])
    assert new == 3 and topology.nlist(table) == 4
    table = topology.set_centroid(table, 0, [5.0, 5.0])
    assert {r["cluster_id"]: r["centroid"] for r in table.collect()}[0] == [5.0, 5.0]
    placed = spark.createDataFrame([("a", 0), ("b", 3)], "ext_id string, cluster_id int")
    assert [r["ext_id"] for r in topology.set_centroids(table.where("cluster_id < 2"), placed)[1].collect()] == ["a"]
    assert topology.needs_compaction(6, 10) and not topology.needs_compaction(8, 10) and not topology.needs_compaction(0, 0)


def test_moved_centroids(spark):
    table = spark.createDataFrame([(0, [2.0, 0.0]), (1, [9.0, 9.0])], "cluster_id int, centroid array<float>")
    live = spark.createDataFrame([(0, 1)], "cluster_id int, live long")
    added = spark.createDataFrame([(0, [4.0, 3.0])], "cluster_id int, vector array<float>")
    got = {r["cluster_id"]: r["centroid"] for r in topology.moved_centroids(table, live, added).collect()}
    assert got == {0: [3.0, 1.5], 1: [9.0, 9.0]}


def test_split(spark, rows):
    placed = search.assign(rows, topology.zero_centroids(spark, 1, 8)).selectExpr("id as ext_id", "vector", "cluster_id", "2 as level")
    again, table = topology.split_large(placed, topology.zero_centroids(spark, 1, 8), most=100)
    assert topology.nlist(table) == 2 and again.count() == 300 and again.select("cluster_id").distinct().count() == 2


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_scores_are_those_of_expressions_and_copies_tie(spark, monkeypatch, metric):
    """Of 700 copies, whose products of matrices may differ in the last places, the smallest ids are found."""
    monkeypatch.setattr(search, "QUERY_TILE", 7)
    monkeypatch.setattr(search, "ROW_TILE", 97)
    r = np.random.default_rng(8)
    x = np.concatenate([np.repeat(r.normal(size=(1, 63)), 700, 0), r.normal(size=(303, 63)), np.zeros((1, 63)), np.full((1, 63), np.nan)])[r.permutation(1005)]
    rows = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "id long, vector array<float>").repartition(3)
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    pairs = rows.crossJoin(asked.withColumnRenamed("vector", "q")).select("query_id", "id", metrics.score(F.col("vector"), F.col("q"), metric).alias("score"))
    want = [tuple(r) for r in search.rank(pairs.where(~F.isnan("score")), 9).select("query_id", "rank", "id", "score").orderBy("query_id", "rank").collect()]
    assert len(want) > 150
    for found in (search.search(rows, asked, 9, metric), search.search_expr(rows, asked, 9, metric)):
        assert [tuple(r) for r in found.select("query_id", "rank", "id", "score").orderBy("query_id", "rank").collect()] == want


def test_scan_holds_tiles_alone(monkeypatch):
    """Products of matrices are of a tile, however many queries meet however many vectors."""
    seen = []
    rough = search.rough_scores
    monkeypatch.setattr(search, "rough_scores", lambda x, q, metric: seen.append((len(q), len(x))) or rough(x, q, metric))
    parts = list(search._tiles(np.arange(0, 4_096, 3), np.arange(10_000), (search.QUERY_TILE, search.ROW_TILE)))
    assert max(len(q) for _, q, _ in parts) <= search.QUERY_TILE and max(len(r) for _, _, r in parts) <= search.ROW_TILE
    assert sum(len(q) * len(r) for _, q, r in parts) == 1_366 * 10_000
    top = search.Best(256, 3, np.arange(0))
    x, q = R.normal(size=(5_000, 8)), R.normal(size=(20, 8))
    for i, some, rows in search._tiles(np.arange(20), np.arange(5_000), (256, 2_048)):
        top.offer(some, q[some], x[rows], rows, search.Metric.IP)
    assert [int(i) for i in top.id[np.lexsort((-top.score, top.query))]] == [int(i) for i in np.argsort(-(q @ x.T), axis=1)[:, :3].ravel()]
    assert max(r for _, r in seen) <= search.ROW_TILE


@pytest.mark.parametrize("metric", [search.Metric.IP, search.Metric.L2])
def test_overflowing_norms(metric):
    x = np.array([[1e200, 0.0], [1e200, 1.0], [0.0, 1.0]])
    top = search.Best(1, 1, np.arange(0))
    top.offer(np.array([0]), np.array([[1e200, 1.0]]) if metric is search.Metric.L2 else np.array([[1e-200, 1.0]]), x, np.arange(3), metric)
    assert top.id.tolist() == [1]


def test_expressions_score_only_what_may_be_found(rows, asked):
    """300 vectors and 6 queries are 1800 pairs; each task gives k of a query at most."""
    assert search.nearest_pairs(rows, asked, 4, "l2").count() <= 5 * 6 * 4


def test_finding_nothing_takes_no_python(spark, rows, asked, tmp_path):
    """The rows to start from, none, came from a list on the driver, and an executor started more Python processes to read it."""
    rows.write.parquet(str(tmp_path / "rows"))
    kept = spark.read.parquet(str(tmp_path / "rows"))
    plan = search.search(kept, asked, 4, "ip")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "RDD" not in plan
    assert search.search(kept, asked.limit(0), 4, "ip").collect() == []
    assert search.search(kept, asked.limit(0), 4, "ip").columns == search.search(kept, asked, 4, "ip").columns


def test_one_large_cluster_meets_its_queries_in_tiles():
    """Queries that probe a cluster are some of a block; a batch's 10,000 rows of it met 4,096 of them at once before."""
    parts = list(search._tiles(np.arange(1, 4_096, 2), np.arange(10_000), (search.QUERY_TILE, search.ROW_TILE)))
    assert all((q // search.QUERY_TILE == tile).all() and len(q) * len(r) * 8 <= 4 << 20 for tile, q, r in parts)
    assert sum(len(q) * len(r) for _, q, r in parts) == 2_048 * 10_000

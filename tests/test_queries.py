"""Registered queries without SQL, on tables made for them."""

from collections import Counter

import numpy as np

from lodestore import queries, queries_more
from lodestore.operators import search
from lodestore.plans import workload
from lodestore.types import LATENCY


def embeddings(spark, folder, ids):
    r = np.random.default_rng(3)
    rows = [(int(i), r.normal(size=64).astype(float).tolist(), int(i) % 10) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_recall_is_over_every_hundredth_row(spark, tmp_path):
    ids = range(250, 550)
    got = {r["nprobe"]: r["recall"] for r in queries.kmeans_recall(spark, embeddings(spark, tmp_path, ids)).collect()}
    assert 0 < got[1] <= got[4] <= got[16] <= 1 and got[16] > 0.8


def test_online_clusters_take_all_rows_in(spark, tmp_path):
    got = queries.l0_online_cluster(spark, embeddings(spark, tmp_path, range(150, 650))).collect()
    sizes = Counter(r["cluster_id"] for r in got)
    assert {r["id"] for r in got} == set(range(150, 650)) and len(got) == 500
    assert all(r["live"] == sizes[r["cluster_id"]] for r in got)


def test_workload_drives_all_rows(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(workload, "drive", lambda e, i, rows, asked, *a, **k: seen.extend([rows, asked]) or spark.createDataFrame([], LATENCY))
    queries_more.workload_latency(spark, embeddings(spark, tmp_path, range(150, 250)))
    assert [i for i, _ in seen[0]] == [str(i) for i in range(150, 250)] and len(seen[1]) == 50


def test_unified_distance_scores_only_what_may_be_found(spark, tmp_path, monkeypatch):
    """Each task hands on ten vectors of a query at most, so no row is made for every pair."""
    seen, near = [], search.nearest_pairs
    monkeypatch.setattr(search, "nearest_pairs", lambda *a: seen.append(near(*a)) or seen[-1])
    folder = embeddings(spark, tmp_path, range(900))
    got = queries.knn_unified_l2sq(spark, folder).collect()
    assert seen[0].count() <= 10 * 9 * spark.read.parquet(f"{folder}/embeddings.parquet").rdd.getNumPartitions()
    assert len(got) == 90 and all(r["distance"] == 0 for r in got if r["rank"] == 1)


def test_recall_finds_true_neighbours_and_places_rows_once(spark, tmp_path, monkeypatch):
    """Each number of probes reads the same tables; before, all of it was computed again for each."""
    made = []
    for name in ("cut", "cut_parts"):
        monkeypatch.setattr(queries.tables, name, lambda df, *a, f=getattr(queries.tables, name), n=name: made.append((n, df.columns[0])) or f(df, *a))
    plan = queries.kmeans_recall(spark, embeddings(spark, tmp_path, range(250, 450)))._jdf.queryExecution().optimizedPlan().toString()
    assert ("cut", "query_id") in made and ("cut_parts", "id") in made
    assert plan.count("MapInArrow") == 3

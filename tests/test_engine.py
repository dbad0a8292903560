"""The engine, its fold, its dumps and its stream: against a plain model."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.encoders import HashingEncoder, PassthroughEncoder, TransformerEncoder
from lodestore.operators import mutate
from lodestore.plans import strategies
from lodestore.plans.engine import Engine
from lodestore.plans.fold import fold
from lodestore.sources import docstore, dumps
from lodestore.streaming.ingest import LOG, Ingest, Pace
from lodestore.streaming.maintenance import Maintenance
from lodestore.types import CENTROIDS, VECTORS


def vec(x):
    return [float(x), 1.0]


def replay(ops, base=()):
    rows = dict(base)
    for op, key, value in ops:
        if op == "insert" or (op == "update" and key in rows):
            rows[key] = value
        elif op == "delete_ids":
            rows.pop(key, None)
    return rows


def log_rows(ops, start=0):
    return [(start + n, 0, op, key, None if op == "delete_ids" else vec(value), None, None if op == "delete_ids" else str(value)) for n, (op, key, value) in enumerate(ops)]


def random_ops(seed, n):
    r = random.Random(seed)
    return [(r.choice(["insert", "update", "delete_ids"]), f"k{r.randrange(6)}", r.randrange(1000)) for _ in range(n)]


def state(df):
    return {r["ext_id"]: int(r["payload"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_fold_is_replay(spark, seed):
    first, second = random_ops(seed, 25), random_ops(seed + 100, 25)
    none = spark.createDataFrame([], VECTORS)
    mid = fold(none, spark.createDataFrame(log_rows(first), LOG))
    assert state(mid) == replay(first)
    assert state(fold(mid, spark.createDataFrame(log_rows(second, 100), LOG))) == replay(second, replay(first))
    assert state(fold(none, spark.createDataFrame(log_rows(first + second), LOG))) == replay(first + second)


def test_insert_if_absent(spark):
    none = spark.createDataFrame([], VECTORS)
    log = spark.createDataFrame(log_rows([("update", "zz", 1)]), LOG)
    assert state(fold(none, log)) == {} and state(fold(none, log, insert_if_absent=True)) == {"zz": 1}


def engine(spark, **more):
    return Engine(spark, PassthroughEncoder(2, normalize=False), **more)


@pytest.mark.parametrize("strategy", ["exact", "ivf", "multilevel"])
def test_searches_see_what_came_before(spark, strategy):
    e = engine(spark, strategy=strategy)
    index = e.create_index("demo", "l2")
    e.add_insert(index, [("a", vec(0), {"tag": "x"}), ("b", vec(5)), ("c", vec(9))])
    e.add_search(index, [vec(0)], 2, "one")
    e.add_delete_ids(index, ["a", "zz"])
    e.add_update(index, [("b", vec(1)), ("missing", vec(0))])
    e.add_search("demo", [vec(0), vec(9)], 1, "two")
    got = e.run()
    hits = {k: [[h[0] for h in q] for q in v] for k, v in got.searches().items()}
    assert hits == {"one": [["a", "b"]], "two": [["b"], ["c"]]}
    assert got.requested == {"insert": 3, "search": 3, "delete_ids": 2, "update": 2}
    assert got.searches()["one"][0][0][2]["tag"] == "x" and "_data" in got.searches()["one"][0][0][2]
    assert e.info(index)["rows"] == 2 and e.run().hits.count() == 0


def test_two_deletes_of_neighbours(spark):
    e = engine(spark)
    index = e.create_index("d", "l2")
    e.add_insert(index, [(str(i), vec(i)) for i in range(4)])
    e.add_delete_knn(index, [vec(0)], 1)
    e.add_delete_knn(index, [vec(0)], 1)
    got = e.run()
    assert got.affected == {"delete_knn": 2} and {r["ext_id"] for r in e.resolve(index).rows.collect()} == {"2", "3"}


def test_ids(spark):
    e = engine(spark)
    index = e.create_index("ids")
    e.add_insert(index, [(0, vec(1)), ("", vec(2)), (None, vec(3)), ("7", vec(4)), (None, vec(5))])
    e.run()
    e.add_insert(index, [(None, vec(6))])
    e.run()
    got = {r["ext_id"] for r in e.resolve(index).rows.collect()}
    assert {"0", "7"} <= got and len(got) == 6
    e.add_insert(index, [("12", vec(1)), *[(None, vec(x)) for x in range(6)]])
    e.run()
    assert e.resolve(index).rows.count() == 13
    u = engine(spark, auto_id="uuid", hash_mode="blake2b64", hash_prefix="h")
    index = u.create_index("u")
    u.add_insert(index, [(None, vec(1)), ("k", vec(2))])
    u.run()
    assert all(r["ext_id"].startswith("h") for r in u.resolve(index).rows.collect())


def test_duplicates_in_a_batch(spark):
    e = engine(spark)
    index = e.create_index("x", "l2")
    e.add_insert(index, [("a", vec(1)), ("a", vec(2))])
    e.run()
    assert [r["vector"] for r in e.resolve(index).rows.collect()] == [vec(2)]


def test_prefixes_of_a_queue(spark):
    ops = random_ops(9, 20)
    whole, parts = engine(spark), engine(spark)
    for e in (whole, parts):
        e.create_index("p", "l2")
    for op, key, value in ops:
        for e in (whole, parts):
            {"insert": e.add_insert, "update": e.add_update}.get(op, lambda i, x: e.add_delete_ids(i, [y[0] for y in x]))("p", [(key, vec(value))])
        if value % 5 == 0:
            parts.run()
    whole.run()
    parts.run()
    assert {r["ext_id"]: r["vector"] for r in whole.resolve("p").rows.collect()} == {r["ext_id"]: r["vector"] for r in parts.resolve("p").rows.collect()} == {k: vec(v) for k, v in replay(ops).items()}


def test_errors(spark):
    e = engine(spark)
    with pytest.raises(KeyError):
        e.add_search("nowhere", [vec(1)], 1)
    index = e.create_index("e")
    with pytest.raises(ValueError):
        e.add_search(index, [vec(1)], 1, nprobe=0)
    with pytest.raises(ValueError):
        engine(spark, strategy="magic")
    e.add_insert(index, [("a", [1.0, 2.0, 3.0])])
    with pytest.raises(Exception):
        e.run()
    with pytest.raises(RuntimeError):
        TransformerEncoder("some/model", 8)


def test_texts_and_documents(spark, tmp_path):
    e = Engine(spark, HashingEncoder(32))
    index = e.create_index("texts")
    e.add_insert(index, [("t1", "hello world", {"role": "u"}), ("t2", "vector store interface", None), {"id": "3", "data": {"b": 1, "a": 2}}])
    e.add_search(index, ["interface of a vector store"], 3, "q")
    assert e.run().searches()["q"][0][0][0] == "t2"
    assert e.get_doc(index, "3")["data"] == '{"a": 2, "b": 1}' and e.doc_store_size(index) == 3 and e.get_doc(index, "9") is None
    e.save_docs(index, str(tmp_path / "docs"))
    assert docstore.read(spark, str(tmp_path / "docs")).count() == 3
    e.add_delete_ids(index, ["3"])
    e.run()
    assert e.get_doc(index, "3") is None
    assert e.catalog().first()["name"] == "texts"


@pytest.mark.parametrize("strategy", ["exact", "ivf"])
def test_dump_and_restore(spark, tmp_path, strategy):
    e = engine(spark, strategy=strategy)
    index = e.create_index("r", "l2")
    e.add_insert(index, [(str(i), vec(i)) for i in range(20)])
    e.run()
    if strategy == "ivf":
        e.train(index, 5)
        assert e.info(index)["nlist"] == 4
    e.dump(index, str(tmp_path / "dump"))
    other = engine(spark, strategy="ivf")
    copy = other.create_index("copy")
    other.restore(copy, str(tmp_path / "dump"))
    other.add_search(copy, [vec(7)], 2, "q", nprobe=4)
    assert [h[0] for h in other.run().searches()["q"][0]] == ["7", "6"]
    one = spark.createDataFrame([("new", vec(50), None, None)], VECTORS)
    dumps.replace_cluster(str(tmp_path / "dump"), 0, one)
    assert {r["ext_id"] for r in dumps.read(spark, str(tmp_path / "dump")).vectors.where("cluster_id = 0").collect()} == {"new"}


def test_document_stores(spark, tmp_path):
    cases = {"list": '["x", {"data": "y", "metadata": {"k": "v"}}]', "object": '{"7": {"data": "z"}, "8": "bare"}', "lines": '{"id": "1", "data": "a"}\n{"id": "2", "data": "b"}\n'}
    got = {}
    for name, body in cases.items():
        (tmp_path / name).write_text(body)
        got[name] = {r["doc_id"]: r["data"] for r in docstore.read(spark, str(tmp_path / name)).collect()}
    assert got == {"list": {"1": "x", "2": "y"}, "object": {"7": "z", "8": "bare"}, "lines": {"1": "a", "2": "b"}}
    records = spark.createDataFrame([("a", "1", None, 0), ("a", "2", None, 1), (None, "3", None, 2)], "doc_id string, data string, metadata map<string,string>, pos int")
    assert [(r["doc_id"], r["data"]) for r in docstore.from_records(records).collect()] == [("a", "2")]


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_converges(spark, tmp_path, batches):
    ops = random_ops(21, 30)
    s = Ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    seen = []
    s.hooks.append(lambda df, n: seen.append(n))
    step = len(ops) // batches
    for b in range(batches):
        s.offer(spark.createDataFrame(log_rows(ops[b * step : (b + 1) * step], b * step), LOG).coalesce(1))
        s.flush()
    assert state(s.snapshot()) == replay(ops) and len(seen) >= batches
    assert s.compact(2.0) and state(s.snapshot()) == replay(ops)
    assert not s.compact(0.0)
    s.offer(spark.createDataFrame(log_rows([("insert", "after", 5)], 1000), LOG))
    s.flush()
    assert state(s.snapshot())["after"] == 5


def test_stream_in_the_background(spark, tmp_path):
    s = Ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    s.offer(spark.createDataFrame(log_rows([("insert", "a", 1)]), LOG))
    s.start(seconds=0.2)
    s.flush()
    assert state(s.snapshot()) == {"a": 1}
    s.stop()


def test_duplicate_ids_are_an_error(spark):
    rows = spark.createDataFrame([("a", 1)], "ext_id string, v int")
    assert mutate.add_unique(rows, spark.createDataFrame([("b", 2)], "ext_id string, v int")).count() == 2
    with pytest.raises(Exception):
        mutate.add_unique(rows, rows).collect()


def test_pace():
    import time

    p, t = Pace(50), time.monotonic()
    for _ in range(4):
        p.wait()
    assert time.monotonic() - t > 0.05


def test_offers_to_a_full_queue(spark, tmp_path):
    one = lambda key, at: spark.createDataFrame(log_rows([("insert", key, at)], at), LOG)
    s = Ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), capacity=2, block=False)
    assert s.offer(one("a", 0)) and s.offer(one("b", 1)) and not s.offer(one("c", 2)) and s.waiting() == 2
    s.flush()
    assert s.waiting() == 0 and s.offer(one("c", 3))
    s.stop()
    assert not s.offer(one("d", 4))
    s.flush()
    assert s.offer(one("d", 5))
    t = Ingest(spark, str(tmp_path / "in2"), str(tmp_path / "out2"), capacity=1)
    assert all(t.offer(one(key, at)) for at, key in enumerate("abc")) and t.waiting() == 1
    assert set(state(t.snapshot())) == {"a", "b"}


def test_routed_stream_and_maintenance(spark, tmp_path):
    table = spark.createDataFrame([(0, [0.0, 1.0]), (1, [100.0, 1.0])], CENTROIDS)
    s = Ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), centroids=table)
    homes = lambda: {r["ext_id"]: r["cluster_id"] for r in s.snapshot().collect()}
    s.offer(spark.createDataFrame(log_rows([("insert", "a", 3), ("insert", "b", 90), ("insert", "c", 1)]), LOG))
    s.flush()
    assert homes() == {"a": 0, "b": 1, "c": 0}
    s.offer(spark.createDataFrame(log_rows([("update", "a", 99), ("delete_ids", "c", None), ("update", "x", 1)], 10), LOG))
    s.flush()
    assert homes() == {"a": 1, "b": 1}
    quiet = Ingest(spark, str(tmp_path / "in3"), str(tmp_path / "out3"))
    m = Maintenance({"leveled": [s, quiet], "one": quiet}, period=0.1)
    assert m.once() == {"leveled": 1, "one": 0} and homes() == {"a": 1, "b": 1}
    m.start()
    m.stop()
    m.collections = {"broken": None}
    m.start()
    m._thread.join(10)
    with pytest.raises(TypeError):
        m.stop()


def test_strategy_of_ones_own(spark):
    class First(strategies.Strategy):
        def search(self, c, rows, queries, k, nprobe):
            return queries.crossJoin(rows.groupBy().agg(F.min("id").alias("id"))).select("query_id", F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score"))

    strategies.register("first", First())
    try:
        e = Engine(spark, PassthroughEncoder(2, normalize=False), "first")
        index = e.create_index("f", "l2")
        e.add("insert", index, [("b", vec(1)), ("a", vec(2))])
        with pytest.warns(UserWarning):
            e.add("rename", index, [])
        e.add("search", index, [vec(1)], k=1, request_id="q")
        assert [h[0] for h in e.run().searches()["q"][0]] == ["a"]
    finally:
        del strategies.STRATEGIES["first"]


def test_levels_run_one_python_step_at_a_time(spark, monkeypatch):
    """Placing rows and summing them in the same tasks took two Python processes a core; rows to start from, none, one more."""
    plans, cut = [], Engine._cut
    monkeypatch.setattr(Engine, "_cut", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(self, df))
    e = Engine(spark, PassthroughEncoder(2, normalize=False), "multilevel")
    index = e.create_index("i", "ip", clusters=1, max_clusters=4, new_threshold=0.2)
    e.add_insert(index, spark.range(40).select("id", F.array(F.sin("id").cast("float"), F.cos("id").cast("float")).alias("data")))
    e.run()
    assert any("ArrowEvalPython" in p for p in plans) and any("MapInArrow" in p for p in plans)
    assert not any(("ArrowEvalPython" in p and "MapInArrow" in p) or "LogicalRDD" in p for p in plans)
    assert e.resolve(index).rows.where("level = 0 and cluster_id is not null").count() == 40
    e.close()


def test_levels_have_routing_tables(spark):
    e = Engine(spark, PassthroughEncoder(2, normalize=False), "multilevel", nprobe=1)
    index = e.create_index("l", "l2")
    table = spark.createDataFrame([(0, [0.0, 1.0]), (1, [10.0, 1.0])], CENTROIDS)
    e.add_insert(index, [(str(i), vec(i)) for i in range(12)])
    e.run()
    e.set_level_centroids(index, 1, table)
    e.set_level_centroids(index, 2, spark.createDataFrame([], CENTROIDS))
    assert set(e.resolve(index).levels) == {1}
    e.set_level_centroids(index, 2, table)
    e.promote(index)
    assert {r["ext_id"]: r["cluster_id"] for r in e.resolve(index).rows.collect()} == {str(i): int(i > 5) for i in range(12)}
    e.add_search(index, [vec(5)], 3, "q")  # of the nearest cluster alone
    assert [h[0] for h in e.run().searches()["q"][0]] == ["5", "4", "3"]
    e.set_level_centroids(index, 0, table)
    for bad in (lambda: e.set_level_centroids(index, 3, table), lambda: e.set_centroids(index, spark.createDataFrame([(0, [1.0])], CENTROIDS)), lambda: Engine(spark, PassthroughEncoder(0))):
        with pytest.raises(ValueError):
            bad()


def test_queries_of_a_table_without_positions(spark):
    e = Engine(spark, PassthroughEncoder(2, normalize=False))
    index = e.create_index("t", "l2")
    e.add_insert(index, [(str(i), vec(i)) for i in range(6)])
    rows = spark.createDataFrame([(vec(i),) for i in range(6)], "data array<float>").repartition(4)
    e.add_search(index, rows, 1, "q")
    e.add_search(index, rows, 1, "q")  # runs together with the one before
    found = e.run().searches()["q"]
    assert len(found) == 12 and sorted(h[0][0] for h in found) == sorted([*map(str, range(6))] * 2)

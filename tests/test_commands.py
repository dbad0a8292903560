"""Datasets by split, and the command lines."""

import json

import pytest
from pyspark.sql import functions as F

from lodestore.__main__ import levels, parse, qps
from lodestore.functions import keys
from lodestore.sources.loaders import BUILDERS, Dataset


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "data" / "train").mkdir(parents=True)
    lines = [{"query": f"q{i}", "tools": "t", "answers": "a"} for i in range(4)]
    (tmp_path / "data" / "train" / "rows.json").write_text("\n".join(map(json.dumps, lines)))
    return str(tmp_path / "data")


def test_datasets_are_built_once(spark, calls):
    d = Dataset(spark, "function_calls", calls, limit=3)
    assert d.data() is d.data() and d.data().count() == 3 and d.rows().count() == 4
    assert Dataset(spark, "function_calls", calls, limit=0).data().count() == 4
    assert Dataset(spark, "chats", calls).split == "train_sft" and Dataset(spark, "chats", calls, "test").split == "test"
    own = Dataset(spark, "function_calls", calls, build=lambda rows, limit: rows.select("query"))
    assert own.data().columns == ["query"]
    with pytest.raises(RuntimeError):
        Dataset(spark, "function_calls", calls, "absent").rows()
    with pytest.raises(RuntimeError):
        Dataset(spark, "other", calls)


@pytest.mark.parametrize("name", sorted(BUILDERS))
def test_each_dataset_has_a_builder(spark, tmp_path, name):
    d = Dataset(spark, name, str(tmp_path))
    (tmp_path / d.split).mkdir()
    (tmp_path / d.split / "rows.json").write_text("{}")
    assert d.data().count() == 0 and {"agent", "request_index", "trace"} <= set(d.data().columns)


def test_command_lines(spark, calls, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"limit": 2, "qps": 1000, "k": 2}))
    args = parse(["qps", "--path", calls, "--dataset", "function_calls", "--config", str(tmp_path / "c.json"), "--prefill", "1", "--out", str(tmp_path / "out")])
    assert args.limit == 2 and args.qps == [1000.0]
    got = qps(spark, args)
    assert {k["kind"] for k in got[0]["kinds"]} == {"insert", "search"}
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    (tmp_path / "c.json").write_text(json.dumps({"colour": 2}))
    for bad in (["qps"], ["qps", "--path", "x", "--config", str(tmp_path / "c.json")], ["other"]):
        with pytest.raises(SystemExit):
            parse(bad)
    out = levels(spark, parse(["levels", "--n", "30", "--dim", "4", "--k", "2"]))
    assert out["rows"] == 30 and out["hits"] == 60


def test_null_keys_have_the_id_of_their_position(spark):
    rows = spark.createDataFrame([(None, 3), ("3", 0), ("x", 1)], "k string, p int")
    got = [r[0] for r in rows.select(keys.doc_id(F.col("k"), F.col("p"))).collect()]
    import hashlib

    word = lambda t: str(int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") & (1 << 63) - 1)
    assert got == [word("3"), "3", word("x")]
    assert rows.select(keys.doc_id(F.col("k"))).first()[0] is None
    assert rows.select(keys.hash_key(F.col("k"), "python", "p-")).collect() == rows.select(keys.hash_key(F.col("k"), "xxhash64", "p-")).collect()

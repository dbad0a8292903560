"""Column functions on hand-made rows."""

import hashlib
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestore.functions import keys, metrics, text
from lodestore.types import Metric


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def pair(spark, a, b, expr):
    return spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(expr(F.col("a"), F.col("b")).alias("y")).first()["y"]


@pytest.mark.parametrize(("a", "b"), [([1.0, 2.0], [3.0, -1.0]), ([0.0, 0.0], [1.0, 0.0]), ([0.5, 0.5], [0.5, 0.5])])
def test_metrics(spark, a, b):
    d = sum(x * y for x, y in zip(a, b, strict=True))
    na, nb = math.hypot(*a), math.hypot(*b)
    l2 = sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assert pair(spark, a, b, metrics.dot) == pytest.approx(d)
    assert pair(spark, a, b, metrics.l2_squared) == pytest.approx(l2)
    assert pair(spark, a, b, metrics.cosine_distance) == pytest.approx(1.0 if na * nb == 0 else 1 - d / (na * nb))
    assert pair(spark, a, b, lambda x, y: metrics.score(x, y, "cosine")) == pytest.approx(d / ((na + 1e-8) * (nb + 1e-8)))
    assert pair(spark, a, b, lambda x, y: metrics.score(x, y, "l2")) == pytest.approx(-math.sqrt(l2))
    assert pair(spark, a, b, lambda x, y: metrics.distance(x, y, "ip")) == pytest.approx(-d)
    assert pair(spark, a, b, lambda x, y: metrics.distance(x, y, "cosine", normalized=True)) == pytest.approx(1 - d)


def test_dimensions(spark):
    assert pair(spark, [1.0], [1.0, 2.0], metrics.dot) is None
    assert one(spark, [1.0, 2.0, 3.0], "array<float>", lambda x: metrics.fit_dim(x, 2)) == [1.0, 2.0]
    assert one(spark, [1.0], "array<float>", lambda x: metrics.fit_dim(x, 3)) == [1.0, 0.0, 0.0]
    with pytest.raises(PySparkException):
        one(spark, [1.0], "array<float>", lambda x: metrics.require_dim(x, 3))
    assert one(spark, [3.0, 4.0], "array<float>", metrics.normalize) == pytest.approx([0.6, 0.8])


def test_metric_names():
    assert [Metric.parse(n) for n in ("COS", "dot", "inner_product", "Euclidean")] == [Metric.COSINE, Metric.IP, Metric.IP, Metric.L2]
    with pytest.raises(ValueError):
        Metric.parse("manhattan")


def test_hashes(spark):
    want = hashlib.blake2b(b"user-1", digest_size=8).hexdigest()
    assert one(spark, "user-1", "string", lambda x: keys.hash_key(x, "blake2b64", "p")) == "p" + want
    assert one(spark, "user-1", "string", lambda x: keys.hash_key(x, "sha1_64")) == hashlib.sha1(b"user-1").hexdigest()[:16]
    assert one(spark, "user-1", "string", keys.doc_id) == str(int(want, 16) & (2**63 - 1))
    assert [one(spark, k, "string", keys.doc_id) for k in ("007", "+5", "-3", " 8 ")] == ["7", "5", "-3", "8"]
    with pytest.raises(ValueError):
        keys.hash_key(F.lit("x"), "md5")


def test_next_id(spark):
    rows = spark.createDataFrame([("7",), ("x",), (None,)], "k string")
    assert rows.agg(keys.next_id(F.col("k"))).first()[0] == 8
    assert rows.where("k = 'x'").agg(keys.next_id(F.col("k"))).first()[0] == 1


def test_strip_and_summaries(spark):
    assert one(spark, "　\t hi\n", "string", text.strip) == "hi"
    assert one(spark, "a  b\n\nc", "string", text.summary) == "a b c"
    assert one(spark, "x" * 200, "string", text.summary) == "x" * 157 + "..."
    assert one(spark, "One. Two! Three", "string", text.first_sentences) == "One."
    assert one(spark, "没有。 好", "string", text.first_sentences) == "没有。"
    assert one(spark, " a b  c d", "string", lambda x: text.first_words(x, 3)) == "a b c"


def test_tagged_sections(spark):
    got = one(spark, "<thinking>a\nb</thinking> <output>c<\\output> <bad>d</other>", "string", text.tagged_sections)
    assert [(s["tag"], s["body"]) for s in got] == [("thinking", "a\nb"), ("output", "c")]


def test_payload_text(spark):
    assert one(spark, {"b": "1", "a": "2"}, "map<string,string>", lambda x: text.payload_text(x, "map")) == '{"a":"2","b":"1"}'
    assert one(spark, [1, 2], "array<int>", lambda x: text.payload_text(x, "array")) == "[1,2]"


def test_ratio():
    assert text.parse_ratio("3:1") == (3, 1) and text.parse_ratio("1/4") == (1, 4)
    for bad in ("", "1", "0:1", "a:b", "1:2:3"):
        with pytest.raises(ValueError):
            text.parse_ratio(bad)

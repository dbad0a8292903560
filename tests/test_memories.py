"""Memory texts, statistics and sources."""

import itertools

import pytest
from pyspark.sql import functions as F

from lodestore.operators import memories, stats
from lodestore.sources import datasets


def loop_pairs(turns):
    """The pairing rule, turn by turn."""
    out, pending = [], None
    for role, text in turns:
        if not text.strip():
            continue
        if role == "user":
            pending = text.strip()
        elif role == "assistant" and pending:
            out.append((pending, text.strip()))
            pending = None
    return out


def test_pairing_is_the_loop(spark):
    turns = [("user", "u{}"), ("assistant", "a{}"), ("system", "s{}"), ("user", " "), ("assistant", "")]
    cases = [[(r, t.format(i)) for i, (r, t) in enumerate(c)] for n in range(5) for c in itertools.product(turns, repeat=n)]
    rows = spark.createDataFrame([(c, [(r, t) for r, t in case]) for c, case in enumerate(cases)], "c int, messages array<struct<role:string,content:string>>")
    got = {r["prompt"]: [(t["user"], t["assistant"]) for t in r["trace"]] for r in memories.chats(rows, "c", F.col("c").cast("string"), F.col("messages")).collect()}
    assert got == {str(c): p for c, case in enumerate(cases) if (p := loop_pairs(case))}
    flat = spark.createDataFrame([(c, i, r, t) for c, case in enumerate(cases) for i, (r, t) in enumerate(case)], "c int, i int, role string, text string")
    pairs = {}
    for r in memories.pair_turns(flat, "c", "i").orderBy("c", "i").collect():
        pairs.setdefault(str(r["c"]), []).append((r["asked"], r["answered"]))
    assert pairs == got


def test_chat_texts(spark):
    rows = spark.createDataFrame([(1, " p ", [("User ", "hi"), ("assistant", "yo")]), (0, None, []), (2, "q", [("user", "a"), ("assistant", "b")])], "i int, prompt string, messages array<struct<role:string,content:string>>")
    out = memories.chats(rows, "i", F.col("prompt"), F.col("messages"), limit=1).collect()
    assert [(r["request_index"], r["trace"][0]["text"]) for r in out] == [(0, f"agent role: {memories.CHAT_ROLE}\n initial question: p\n user question: hi\n answer: yo")]
    assert memories.agents(memories.chats(rows, "i", F.col("prompt"), F.col("messages"))).count() == 1


def test_trajectories(spark):
    talk = [("human", "Be good. Always."), ("gpt", "ok"), ("human", "go"), ("GPT", "went")]
    rows = spark.createDataFrame([(i, talk if i < 3 else [("gpt", "alone")]) for i in range(4)], "i int, conversations array<struct<`from`:string,value:string>>")
    rows = rows.withColumn("messages", F.lit(None).cast("array<struct<`from`:string,value:string>>"))
    out = memories.trajectories(rows, "i", memories.first_filled_list(F.col("messages"), F.col("conversations")), limit=2).orderBy("request_index").collect()
    assert [(r["agent"], r["request_index"]) for r in out] == [("Be good. Always.", 0), ("Be good. Always.", 1)]
    assert out[0]["trace"][1]["text"] == "agent role: Be good.\nhuman question: go\ngpt answer: went"


def test_math_steps(spark):
    rows = spark.createDataFrame([(0, "q1", "r1", "none"), (1, "q2", "r2", " 4 "), (2, "q1", "r3", None), (3, "q3", "r", None), (4, " ", "r", None)], "i int, q string, r string, a string")
    out = memories.math_steps(rows, "i", F.col("q"), F.col("r"), F.col("a"), limit=2).orderBy("request_index").collect()
    assert [[t["text"] for t in r["trace"]] for r in out] == [
        [f"agent role: {memories.STEPS_ROLE}\nquestion: q1\nresponse: {x}" for x in ("r1", "r3")],
        [f"agent role: {memories.STEPS_ROLE}\nquestion: q2\nresponse: r2\nanswer: 4"],
    ]


def test_tagged_reasoning(spark):
    rows = spark.createDataFrame([(0, "q", "42", "<thinking>a</thinking><output>b<\\output><x> </x>"), (1, "q", None, "no tags")], "i int, q string, a string, g string")
    out = memories.tagged_reasoning(rows, "i", F.col("q"), F.col("a"), F.col("g")).collect()
    assert [t["text"].split("\n", 1)[1] for t in out[0]["trace"]] == ["question: q\nanswer: [thinking] a", "question: q\nanswer: [output] b\nground truth answer: 42"] and len(out) == 1


def test_feedback(spark):
    rows = spark.createDataFrame(
        [(0, "q", ["m1", "m2", "m3"], [("r1", "c1", 7.5, {"honesty": "5"}), (" ", "c", 1.0, {})])],
        "i int, q string, models array<string>, completions array<struct<response:string,critique:string,overall_score:double,annotations:map<string,string>>>",
    )
    texts = [t["text"] for t in memories.feedback(rows, "i", F.col("q"), F.col("models"), F.col("completions")).first()["trace"]]
    assert len(texts) == 6
    assert texts[0] == f"agent role: {memories.SOLVE_ROLE} question: q model: m1 answer: r1"
    assert texts[1] == f"agent role: {memories.CRITIQUE_ROLE} critique: c1, overall_score: 7.5"
    assert texts[3] == f"agent role: {memories.eval_role('honesty')} evaluation: 5" and texts[2].endswith("evaluation: ")


def test_function_calls_and_flatten(spark):
    rows = spark.createDataFrame([(0, "q", "t", "a"), (1, "q", "", "a"), (2, "q2", "t2", "a2")], "i int, q string, t string, a string")
    out = memories.function_calls(rows, "i", F.col("q"), F.col("t"), F.col("a"))
    flat = memories.flatten(out).orderBy("request_index", "trace_index").collect()
    assert [r["text"] for r in flat][3:] == [f"agent role: {memories.CALLS_ROLE} question: q2", memories.TOOLS_TEXT + "t2", memories.CALL_TEXT + "a2"]
    assert memories.flatten(out, 2).count() == 2


def test_passages_and_questions(spark):
    rows = spark.createDataFrame([(0, "a", None, "T", "x"), (1, None, None, None, "y"), (2, "a", None, None, "z"), (3, "b", None, None, " ")], "o int, text_id string, id string, title string, text string")
    out = {r["id"]: (r["text"], r["metadata"]) for r in memories.first_per_id(rows, "o").collect()}
    assert out == {"a": ("x", {"title": "T"}), "1": ("y", None)}
    qa = spark.createDataFrame([(0, "q", ["a", "b"]), (1, "q", []), (2, " ", ["a"])], "o int, question string, golden_answers array<string>")
    assert [tuple(r) for r in memories.questions(qa, "o").collect()] == [("q", "a")]


def test_entry_text(spark):
    row = spark.createDataFrame([(None, "u", "a"), ("t", "u", "a"), (None, None, None)], "text string, user string, assistant string")
    fields = [F.col("user"), F.col("assistant")]
    assert [r[0] for r in row.select(memories.entry_text(F.col("text"), fields, True)).collect()] == ["u a", "t", None]
    assert [r[0] for r in row.select(memories.entry_text(F.col("text"), fields, False)).collect()] == ["u", "t", None]


def test_statistics(spark):
    rows = spark.createDataFrame([("s", x / 1000) for x in range(1, 101)], "kind string, seconds double")
    r = stats.latency_summary(rows).first()
    assert (r["n"], round(r["mean"], 6), round(r["p50"], 6), round(r["p95"], 6), round(r["max"], 6)) == (100, 50.5, 50.5, 95.05, 100.0)
    runs = spark.createDataFrame([(10, 5, 1.0), (5, 0, 1.0)], "inserted int, queries int, seconds double")
    assert stats.throughput(runs).first()["ops_per_sec"] == 10
    chunks = stats.chunked(spark.range(10).withColumnRenamed("id", "n").repartition(3), "n", 4).orderBy("n").collect()
    assert [r["chunk"] for r in chunks] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    words = spark.createDataFrame([("b",), ("a",), ("c",)], "w string")
    assert {r["w"]: r["row"] for r in stats.numbered(words, "w").collect()} == {"a": 0, "b": 1, "c": 2}


def test_sources(spark, tmp_path):
    (tmp_path / "calls.json").write_text('{"query": "q", "tools": "t", "answers": "a"}\n')
    assert datasets.scan(spark, "function_calls", str(tmp_path / "calls.json")).first()["tools"] == "t"
    for name, path in (("nothing", "x"), ("chats", str(tmp_path / "missing.json"))):
        with pytest.raises(RuntimeError):
            datasets.scan(spark, name, path)
    a, b = (datasets.synthetic(spark, 5, 3).collect() for _ in range(2))
    assert a == b and a[0]["ext_id"] == "ins-0" and len(a[0]["vector"]) == 3
    (tmp_path / "c.json").write_text('{"top_k": 5}')
    assert datasets.config(str(tmp_path / "c.json")) == {"top_k": 5}
    for _ in range(2):
        datasets.append_result(spark.createDataFrame([(1, 2.0)], "run int, ops double"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2

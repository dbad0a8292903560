"""The pipeline and the registered queries, on the smallest tables."""

import pytest

import corpus_pipeline
from lodestore import tables
from lodestore.llm import minhash, pieces
from lodestore.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "sentencepiece":
            assert after.columns == names
        if name == "line_dedup":
            assert after.count() == docs.count()
        if name == "minhash":
            assert minhash.linked(after).where("not kept").count() == 0
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == {r["component_id"] for r in minhash.linked(docs).collect()}
        if name == "sentencepiece":
            assert after.where("not round_trip").count() == 0 and after.count() == docs.count()
            v = pieces.load()
            texts = {(r["doc_id"]): r["text"] for r in docs.collect()}
            for r in after.limit(5).collect():
                assert r["ids"] == v.encode(" " + texts[r["doc_id"]]).tolist()
        docs = after


def test_run_keeps_what_the_stages_keep(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) == {"doc_id", "lang", "source", "n_ids", "ids", "round_trip"} and out.count() > 0


def test_only_near_copies_keep_lines_of_many_sites(spark):
    shared = "\n".join(f"boilerplate {k} that stands on many sites" for k in range(12))
    rows = [(i, f"{shared}\n" + " ".join(f"w{i}x{j}" for j in range(60 if i < 8 else 30)), f"s{i % 8}") for i in range(10)]
    rows += [(20 + i, shared, f"s{i}") for i in range(3)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, docs, SF).collect()}
    own = {i: t.split("\n")[-1] for i, t, _ in rows}
    assert got[0] == rows[0][1] and all(got[i] == own[i] for i in range(1, 10))
    assert all(got[20 + i] == shared for i in range(3))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, None, None, None, None), (None, "some words of a text without an id", "en", None, 3), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, "en", "a", None), (3, " \t\n", "en", "b", 3), (4, "word " * 40_000, "en", "c", 200_000), (5, "w" * 100_000, "en", "c", 100_000), (6, "five words or a few more", "en", "a", 24), (7, "five words or a few more", "en", "b", 24), (7, "five words or a few more", "en", "b", 24)]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage):
    docs = spark.createDataFrame(ODD, DOCS)
    last = stage is corpus_pipeline.to_ids
    got = stage(spark, docs, SF)
    rows = got.collect()
    if last:
        assert len(rows) == len(ODD) and all(r["round_trip"] for r in rows)
        assert all(r["n_ids"] == 0 for r in rows if r["doc_id"] in (1, 2))
    else:
        assert got.columns == docs.columns
        texts = sorted(str(r["text"]) for r in rows)
        if stage is corpus_pipeline.drop_copies:
            assert texts == sorted(str(r[1]) for r in ODD if r[0] != 7)
        elif stage is corpus_pipeline.drop_lines:
            assert texts == sorted(str(r[1]) for r in ODD)
        else:
            assert set(texts) <= {str(r[1]) for r in ODD}
    assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("stage", [s for n, s in corpus_pipeline.STAGES if n != "sentencepiece"])
def test_stages_keep_other_columns(spark, stage):
    extra = "score double, size string, ids int, component_id int, held_out string, `__gone` int"
    docs = spark.createDataFrame([(*r, 0.5, "own", 7, 8, "x", 9) for r in ODD if r[0] != 4], f"{DOCS}, {extra}")
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns and {(r["size"], r["ids"], r["__gone"]) for r in got.collect()} <= {("own", 7, 9)}


def test_operators_leave_the_session_and_its_folder_as_they_were(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.conf.get(key)
    with tables.scratch():
        for name, q in QUERIES.items():
            q(spark, SF).count()
            assert spark.conf.get(key) == rows, name
    folder = spark._jvm.org.apache.hadoop.fs.Path(tables.shared_dir(spark))
    before = set(tables._made)
    with tables.scratch():
        corpus_pipeline.run(spark, SF).count()
        made = set(tables._made) - before
    assert made and not made & set(tables._made)
    left = [str(f.getPath()) for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    assert not [p for p in left if p.rsplit("/", 1)[-1] in {m.rsplit("/", 1)[-1] for m in made}]

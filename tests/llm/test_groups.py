"""Near duplicates and neighbours: against brute force."""

import random
import re

import numpy as np
import pytest

from lodestore.llm import ann, common, embed_dedup, minhash


def union(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(40)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    ids = {i for e in links if e[0] != e[1] for i in e}
    assert got == union(ids, [e for e in links if e[0] != e[1]])
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def copies(r, n, edits):
    base = [f"w{r.randrange(4000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randint(0, edits)):
            t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_minhash_links_are_those_of_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "SHORT", 6)
    r = random.Random(width)
    texts = copies(r, 90, 6) + copies(r, 6, 3) + copies(r, 2, 1) + [" ".join(f"u{r.randrange(10**6)}" for _ in range(50)) for _ in range(40)]
    texts += ["Same Words  here", "same words here", "a", "A", "", None, " \t ", "one two three", "word " * 20_000, "word " * 19_000]
    r.shuffle(texts)
    sets = [shingle_set(t, width) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = union(range(len(texts)), links)
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, component_id int")
    got = minhash.linked(rows, width).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) and x["n_shingles"] == len(sets[x["doc_id"]]) for x in got)
    kept = minhash.dedup(rows, width)
    assert kept.columns == rows.columns and {x["doc_id"] for x in kept.collect()} == set(want.values())


def test_minhash_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "A B c d  e f")], "doc_id long, text string")
    got = sorted((x["doc_id"] or -1, x["component_id"], x["kept"]) for x in minhash.linked(rows).collect() if x["doc_id"])
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash.linked(rows).count() == 5 and minhash.linked(rows.where("doc_id = 9")).count() == 0
    assert sorted(str(x["doc_id"]) for x in minhash.dedup(rows).collect()) == ["1", "1", "None", "None"]


def test_minhash_keeps_other_texts_of_a_repeated_id(spark):
    rows = spark.createDataFrame([(3, "a b c d e f g"), (5, "a b c d e f g"), (5, "h i j k l m n o"), (5, None)], "doc_id long, text string")
    assert sorted((x["doc_id"], x["text"] or "") for x in minhash.dedup(rows).collect()) == [(3, "a b c d e f g"), (5, ""), (5, "h i j k l m n o")]


def cloud(seed, n, dim=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 4, dim))
    x = np.concatenate([base, base[r.integers(0, len(base), n - len(base))] + r.normal(size=(n - len(base), dim)) * r.choice([0.02, 0.25, 0.5], (n - len(base), 1))])
    return x * r.uniform(0.5, 3, (n, 1))


def test_embedding_links_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 40)
    monkeypatch.setattr(embed_dedup, "TILE", 24)
    x = cloud(1, 400)
    x[50] = x[10]
    label = [int(i % 2) if i % 17 else None for i in range(400)]
    label[50] = label[10] = 0
    rows = [(i, [float(v) for v in x[i]], label[i]) for i in range(400)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [1.0] * 15 + [None], 0), (404, [1.0] * 3, 0), (405, [2.0] * 3, 0)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    links = [(i, j) for i in range(400) for j in range(i) if near[i, j] and label[i] == label[j] and label[i] is not None] + [(405, 404)]
    want = union(range(406), links)
    got = embed_dedup.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: r["component_id"] for r in got} == want
    count = dict.fromkeys(range(406), 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert {r["vec_id"]: r["n_links"] for r in got} == count


def test_embeddings_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.linked(none).count() == 0 and ann.nearest(none, none["vec_id"] >= 0).count() == 0


def test_neighbours_recall(spark):
    x = cloud(2, 1500)
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("inf")] * 16), (5003, [1.0] * 5)]
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(1500)] + bad, "vec_id long, embedding array<double>")
    got = ann.nearest(rows, rows["vec_id"] % 20 == 0).collect()
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    hits = 0
    for q in range(0, 1500, 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and q not in {r["vec_id"] for r in mine}
        assert all(abs(r["score"] - score[q, r["vec_id"]]) < 1e-9 for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(np.argsort(-score[q])[:20].tolist()))
    assert hits / (75 * 20) >= 0.95 and not {r["vec_id"] for r in got} & {5000, 5001, 5002, 5003}


def test_few_candidates_are_all_found(spark):
    rows = spark.createDataFrame([(20 * i, [float(i), 1.0]) for i in range(1, 6)], "vec_id long, embedding array<double>")
    got = ann.nearest(rows, rows["vec_id"] % 20 == 0).collect()
    assert len(got) == 20


def test_equal_vectors_are_one_node(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([np.repeat(r.normal(size=(1, 16)), 2900, 0), r.normal(size=(100, 16))])
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    graphs = ann.index(rows.select("vec_id", F.col("embedding").alias("v"))).collect()
    assert sum(len(g["counts"]) // 4 for g in graphs) == 101 and all(len(g["starts"]) // 4 <= 3 for g in graphs)
    got = ann.nearest(rows, rows["vec_id"] % 20 == 0).collect()
    score = x @ x[::20].T
    for k, q in enumerate(range(0, 3000, 20)):
        mine = [a["vec_id"] for a in sorted((a for a in got if a["query_id"] == q), key=lambda a: a["rank"])]
        assert mine == sorted((i for i in range(3000) if i != q), key=lambda i: (-round(score[i, k], 9), i))[:20]


def test_neighbours_of_repeated_ids_and_clashing_columns(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (None, [1.0, 1.0]), (4, [])]
    rows = spark.createDataFrame([(i, v, "x", 7, 8, 9.0) for i, v in rows], "vec_id long, embedding array<double>, rank string, shard int, query_id int, score double")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(rows, rows["vec_id"] % 20 == 0).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 0.0), (20, 4, 3, 0.0)]


def test_a_full_shard_is_searched_well():
    """Real shards: vectors in clusters, as many as a shard holds."""
    r = np.random.default_rng(8)
    centre = r.normal(size=(200, 32))
    x = centre[r.integers(0, 200, ann.SHARD_ROWS)] + 0.6 * r.normal(size=(ann.SHARD_ROWS, 32))
    lifted = ann.lifted(x).astype(np.float32)
    graph, starts = ann.grow(lifted)
    near = ann.walk(lifted, graph, starts, np.column_stack([x[:256], np.zeros(256)]).astype(np.float32), ann.SEARCH_BEAM)[0]
    score = x[:256] @ x.T
    hits = 0
    for i in range(256):
        mine = near[i][near[i] >= 0]
        hits += len(set(mine[np.argsort(-score[i][mine])][:20].tolist()) & set(np.argsort(-score[i])[:20].tolist()))
    assert hits / (256 * 20) >= 0.95 and len(starts) < 64


def test_embedding_links_of_repeated_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (None, [1.0, 0.0])]
    rows = spark.createDataFrame([(i, v, 0, "a", "b", 3) for i, v in rows], "vec_id long, embedding array<double>, label int, grp string, cell string, kept int")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.linked(rows).collect())
    assert got == [(-1, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    assert embed_dedup.dedup(rows).columns == rows.columns

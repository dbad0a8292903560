"""Classifiers and the language model: held-out accuracy, and models in plain Python."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestore.llm import lm, quality, toxicity

WORDS = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "green", "seven", "quiet"]


def corpus(seed, n):
    """Documents with a few bad words, or of bad form, and their labels."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(WORDS) + r.choice(["", "s", "ed"]) for _ in range(r.randint(20, 200))]
        toxic = r.random() < 0.2
        for _ in range(r.randint(2, 5) if toxic else 0):
            words[r.randrange(len(words))] = "gruk" + r.choice(["el", "ing", "an", "os"])
        good = r.random() < 0.8
        text = " ".join(words) + "."
        if not good:
            text = " ".join(w + "%%%" for w in words) if i % 2 else " ".join(w for w in words[:6] for _ in range(12))
        rows.append((i, text, "own"))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_documents_are_told_apart(spark, module, label):
    rows, labels = corpus(5, 600)
    odd = [(None, None, "x"), (900, "", "x"), (901, "word " * 30_000, "x"), (1, rows[1][1], "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (902, None, None), (0, *labels[0][1:])], "doc_id long, quality int, toxic int")
    got = module.classify(docs, known).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    true = {i: (t if label == "toxic" else q) for i, q, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in true]
    mod, rest = (4, 2) if label == "toxic" else (5, 0)
    assert {r["doc_id"] for r in held} == {i for i in true if zlib.crc32(str(i).encode()) % mod == rest}
    assert np.mean([r["predicted"] == true[r["doc_id"]] for r in held]) > 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_without_labels_or_documents(spark, module):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert module.classify(docs, none).count() == 1
    assert module.classify(docs.where("doc_id = 2"), none).count() == 0


def test_long_words_are_learned_whole(spark, monkeypatch):
    r = random.Random(4)
    long = lambda n: "".join(r.choice("abé語") for _ in range(n))
    rows = [(i, " ".join(long(r.choice([1, 3, 7, 8, 9, 30, 100])) for _ in range(6))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")

    def learned(longest):
        monkeypatch.setattr(toxicity, "LONGEST", longest)
        return toxicity.train(docs, known, F.lit(True)).evidence

    whole = learned(10**6)
    for longest in (8, 64):
        some = learned(longest)
        assert whole.grams.tolist() == some.grams.tolist() and whole.contexts.tolist() == some.contexts.tolist()
        assert np.allclose(whole.gram_values, some.gram_values) and np.allclose(whole.context_values, some.context_values)


def plain_kneser_ney(toxic, ordinary):
    """log P(last byte | 5 before) of toxic less ordinary, from dicts of counts of 6-byte strings."""
    seen = {g for c in (toxic, ordinary) for g, n in c.items() if n}
    after = {n: collections.Counter() for n in range(1, 6)}
    grams = seen
    for n in range(5, 0, -1):  # in how many different ways a string is continued to the left
        after[n].update(g[1:] for g in grams)
        grams = set(after[n])
    d = toxicity.DISCOUNT

    def shared(g):
        p = 1 / 257
        for n in range(1, 6):
            own = {x: c for x, c in after[n].items() if x[:-1] == g[-n:-1]}
            if own:
                t = sum(own.values())
                p = (max(own.get(g[-n:], 0) - d, 0) + d * len(own) * p) / t
        return p

    def log_p(counts, g):
        own = {x: n for x, n in counts.items() if n and x[:5] == g[:5]}
        t = sum(own.values())
        back = toxicity.TOP_DISCOUNT * len(own) / t if t else 1.0
        return math.log(max(counts.get(g, 0) - toxicity.TOP_DISCOUNT, 0) / max(t, 1e-9) + back * shared(g)), math.log(back)

    def evidence(g):
        if g in seen:
            return log_p(toxic, g)[0] - log_p(ordinary, g)[0]
        if any(x[:5] == g[:5] for x in seen):
            return log_p(toxic, g)[1] - log_p(ordinary, g)[1]
        return 0.0

    return evidence


def six(word):
    padded = b" " * 5 + word.lower() + b" "
    return [padded[i : i + 6] for i in range(len(word) + 1)]


def test_evidence_is_that_of_plain_kneser_ney_models():
    toxic, ordinary = collections.Counter(), collections.Counter()
    for words, counts in ((["grukel", "gruking", "Grukan", "stone", "a"], toxic), (["stone", "stones", "green", "river", "a", "a"], ordinary)):
        for w in words:
            counts.update(six(w.encode()))
    want = plain_kneser_ney(toxic, ordinary)
    names = sorted(set(toxic) | set(ordinary))
    learned = toxicity.learn(np.array([int.from_bytes(g, "big") for g in names], np.uint64), np.array([toxic[g] for g in names]), np.array([ordinary[g] for g in names]))
    texts = ["grukel stone GRUK", "greens rivers zebra a", "", "é grukos"]
    data, at = toxicity.textnp.raw(pa.array(texts))
    begin, end, _ = toxicity.textnp.spans(data, at)
    hashes = toxicity.textnp.word_hashes(data, begin, end)
    got = toxicity.word_evidence(learned, hashes, data, begin, end, "plain")
    words = [w.encode() for t in texts for w in t.split()]
    assert got.tolist() == pytest.approx([sum(map(want, six(w))) for w in words], rel=1e-4, abs=1e-5)
    x = toxicity.measures(pa.array(texts), learned, "plain")
    for row, t in zip(x, texts, strict=True):
        each = [sum(map(want, six(w.encode()))) for w in t.split()]
        top = sorted({w.lower(): max(v, 0) for w, v in zip(t.split(), each, strict=True)}.values(), reverse=True)[:3]
        assert row.tolist() == pytest.approx([*top, *[0.0] * (3 - len(top)), np.mean(each) if each else 0.0], rel=1e-4, abs=1e-5)


def test_quality_scores_are_sums_of_plain_bins(spark):
    rows, labels = corpus(9, 300)
    rows += [(900, "", "x"), (901, None, "x"), (902, "Word! " * 3000, "x"), (1, rows[1][1], "x")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))

    def plain(text):
        x = quality.features(pa.array([text]))[0]
        words = (text or "").split()
        letters = [c for c in text or "" if c.isascii() and c.isalpha()]
        assert x[0] == pytest.approx(math.log(1 + len(words)))
        assert x[1] == pytest.approx(sum(len(w.encode()) for w in words) / max(1, len(words)))
        assert x[2] == pytest.approx(sum(c.isupper() for c in letters) / max(1, len(letters)))
        assert x[7] == pytest.approx(len({w.lower() for w in words}) / max(1, len(words)))
        total = model.start
        for j, (edges, table) in enumerate(zip(model.edges, model.tables, strict=True)):
            total += table[sum(e <= x[j] for e in edges)]
        for i, j, a, b, table in model.pairs:
            total += table[sum(e <= x[i] for e in a), sum(e <= x[j] for e in b)]
        return 1 / (1 + math.exp(-total))

    for r in quality.score(docs, model).collect():
        assert r["score"] == pytest.approx(plain(r["text"]), rel=1e-9)


def test_gam_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (3000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    model = quality.fit(x, y, np.ones(len(y)))
    z = r.uniform(-1, 1, (1000, 3))
    assert np.mean((model.score(z) > 0.5) == (z[:, 0] * z[:, 1] > 0)) > 0.9


def chain(seed, n):
    """Documents in which half of the words follow from the word before."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice(WORDS)]
        while len(words) < 80:
            words.append(WORDS[(WORDS.index(words[-1]) * 3 + 1) % len(WORDS)] if r.random() < 0.5 else r.choice(WORDS))
        rows.append((i, " ".join(words)))
    return rows


def tokens(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words] + [None]


@pytest.mark.parametrize(("block", "part"), [(lm.BLOCK, lm.PART), (64, 1000), (1, 50)])
def test_lm_scores_are_those_of_a_plain_backoff_model(spark, block, part):
    """Block and part cut texts and lists anywhere, which changes no result."""
    rows = chain(7, 120 if block > 1 else 20)
    rows = rows + [(500, None), (501, ""), (502, "zebra zebra Alpha"), (3, rows[3][1]), (504, "unseen " * (3000 if block > 1 else 30))]
    usable = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1}
    lists = [(i, tokens(t)) for i, t in rows]
    c, pairs, triples = collections.Counter(), collections.Counter(), collections.Counter()
    for i, ts in lists:
        if i in usable:
            c.update(ts)
            pairs.update(zip([None, *ts], ts, strict=False))
            triples.update(zip([None, *ts], ts, ts[1:], strict=False))
    n, v = sum(c.values()), len(c)
    mass = n + 0.5 * (v + 1)
    uni = lambda w: (c[w] + 0.5) / mass
    s2, s3 = lm.STRENGTHS

    def score(ts):
        total = 0.0
        for k, w in enumerate(ts):
            a = ts[k - 1] if k else None
            p = (pairs[a, w] + s2 * uni(w)) / (c[a] + s2)
            if k:
                b = ts[k - 2] if k > 1 else None
                p = (triples[b, a, w] + s3 * p) / (pairs[b, a] + s3)
            total += math.log10(p)
        return total

    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = sorted(lm.score(docs, block=block, part=part).collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(rows)
    for r, (i, ts) in zip(got, sorted(lists, key=lambda x: x[0]), strict=True):
        assert r["doc_id"] == i and r["held_out"] == (i not in usable)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(c[w] > 0 for w in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(uni(w)) for w in ts), rel=1e-9)
        assert r["score"] == pytest.approx(score(ts), rel=1e-9)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 500]
    if block > 1:
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert lm.score(docs).count() == 2 and lm.score(docs.limit(0)).count() == 0
    got = lm.score(docs, usable=F.lit(False)).collect()
    assert {r["n_known"] for r in got} == {0}


def test_lm_keeps_ngrams_of_any_share(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = next(i for i in range(100) if i not in ids)
    rows = [(i, "a " * 120_000) for i in ids[:40]] + [(ids[40], "b c"), (held, "b c")]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    s2, s3 = lm.STRENGTHS
    mass = 40 * 120_000 + 41 + 3 - 1 + 0.5 * 5
    pair = lambda n, c, p: (n + s2 * p) / (c + s2)
    first, second, last = pair(1, 41, 1.5 / mass), pair(1, 1, 1.5 / mass), pair(1, 1, 41.5 / mass)
    want = math.log10(first) + sum(math.log10((1 + s3 * p) / (1 + s3)) for p in (second, last))
    assert got[held]["train_tokens"] == 40 * 120_001 + 3
    assert got[held]["score"] == pytest.approx(want, rel=1e-9)


def test_lm_arcs_of_a_state_sum_to_one():
    counts = np.array([5, 2, 0, 1])
    root = (counts + 0.5) / (8 + 0.5 * 4)
    arcs = [np.array([2, 0, 0, 1]), np.array([1, 0, 0, 1])]
    weight = lm.traverse(root, arcs, [np.full(4, 3), np.full(4, 2)])
    assert (10**weight).sum() == pytest.approx(root.sum())


def test_lm_lists_come_back_whole():
    r = np.random.default_rng(1)
    for low in (0, 1 << 62, 3 << 62):
        keys = np.unique(r.integers(0, 1 << 61, 500, dtype=np.uint64) + np.uint64(low))
        assert (lm.unpacked_keys(lm.packed_keys(keys, low), low, len(keys)) == keys).all()
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert (lm.unpacked_counts(lm.packed_counts(counts), 6) == counts).all()

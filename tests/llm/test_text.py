"""Hashes on raw bytes, pieces, and their parallel scan: against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestore.llm import pieces, textnp
from lodestore.llm.common import grouped

TEXTS = ["Hello  world a b c", "", None, "  x\ty ", "one two three four five", "HELLO world a b c", "q", "é ß\n漢 a", "w" * 3_000_000 + " x"]


def test_words_are_those_of_the_pattern():
    data, at = textnp.raw(pa.array(TEXTS))
    begin, end, first = textnp.spans(data, at)
    got = [bytes(data[a:b]).decode() for a, b in zip(begin, end, strict=True)]
    want = [w for t in TEXTS for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert got == want and np.diff(first).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in TEXTS]


def test_hashes_follow_words_not_places():
    data, at = textnp.raw(pa.array(TEXTS))
    begin, end, first = textnp.spans(data, at)
    h = textnp.word_hashes(data, begin, end)
    assert (h[first[0] : first[1]] == h[first[5] : first[6]]).all()
    assert len(set(h.tolist())) == len({w.lower() if w.isascii() else w for t in TEXTS for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")})
    grams, where = textnp.shingles(h, first, 4)
    assert np.diff(where).tolist() == [2, 0, 0, 1, 2, 2, 1, 1, 1]
    one, two = textnp.sequence_hashes(h, first)
    assert one[0] == one[5] and two[0] == two[5] and one[0] != one[4]


def brute(v, text):
    best = {0: (0.0, [])}
    for i in range(1, len(text) + 1):
        options = []
        for j in range(max(0, i - v.longest), i):
            s = v.score.get(text[j:i], v.unknown if i == j + 1 else None)
            if s is not None:
                options.append(best[j][0] + s)
        best[i] = max(options), None
    return best[len(text)][0]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def random_text(r):
    return " " + "".join(r.choice(["the", "ing", " ", "  ", "\n", "a", "é", "▁", "漢", "tion", "x", "----"]) for _ in range(r.randint(1, 60)))


def test_solve_is_optimal_and_units_are_independent(vocabulary):
    r = random.Random(1)
    for _ in range(100):
        text = random_text(r)
        score, packed = vocabulary.solve(text)
        assert score == brute(vocabulary, text)
        assert vocabulary.encode(text).tolist() == np.frombuffer(packed, np.uint32).tolist()


@pytest.mark.parametrize("chunk", [16, 21, 64])
def test_chunks_are_traced_to_the_same_ids(vocabulary, chunk):
    r = random.Random(chunk)
    for text in [*(random_text(r) for _ in range(60)), " " + "ab" * 100, " " + "=" * 90, " " + "-" * 1000, " " * 200, "a" + " " * 77 + "é" * 40]:
        parts = [(text[i : i + chunk], text[i + chunk : i + chunk + vocabulary.longest - 1]) for i in range(0, len(text), chunk)]
        rests = pieces.rests(np.stack([vocabulary.transfer(*p) for p in parts]))
        found = pieces.states(np.stack([vocabulary.leads(*p, r) for p, r in zip(parts, rests, strict=True)]))
        ids = [i for (body, ahead), (a, b) in zip(parts, found, strict=True) for i in vocabulary.encode((body + ahead[:b])[a:]).tolist()]
        assert ids == vocabulary.encode(text).tolist()
        names = {i: p for p, i in vocabulary.ids.items()}
        units, total, n = re.findall(".", text, re.S), 0.0, 0
        for i in ids:
            if i in names:
                total += vocabulary.score[names[i]]
        spelled = sum(1 for c in units if c not in vocabulary.score)
        assert pieces.Speller.of(vocabulary).decode(pieces._lists([np.array(ids, np.int32)]))[0].as_py() == text[1:]
        assert total + spelled * vocabulary.unknown == vocabulary.solve(text)[0]


def test_max_plus_products_are_associative():
    a, b, c = np.random.default_rng(0).integers(-9, 9, (3, 5, 5)).astype(float)
    assert (pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))).all()
    stack = np.stack([a, b, c, a])
    assert (pieces.scan(stack)[0] == pieces.combine(pieces.combine(a, b), pieces.combine(c, a))).all()


def test_round_trip_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "  two  blanks \n", 5), (1, "  two  blanks \n", 5), (None, "▁ sign", 6), (2, None, 7), (3, "", 8), (4, "long words here " * 400, 9), (5, "x" * 3000, 9), (6, "é漢\u0000\t", 1)], "doc_id long, text string, ids int")
    out = pieces.decode(pieces.encode(rows, chunk=512)).collect()
    assert len(out) == 8 and all((r["text"] or "") == r["decoded"] for r in out)
    assert pieces.encode(rows.where("doc_id = 99")).count() == 0
    whole = {r["doc_id"]: r["ids"] for r in pieces.encode(rows.where("doc_id in (4, 5)")).collect()}
    assert whole == {r["doc_id"]: r["ids"] for r in out if r["doc_id"] in (4, 5)}


def test_ties_are_cut_alike_in_chunks_and_whole(spark):
    rows = spark.createDataFrame([(1, "-" * 40_000), (2, "ab" * 9_000 + "--  --")], "doc_id long, text string")
    one, two = ({r["doc_id"]: r["ids"] for r in pieces.encode(rows, chunk=c).collect()} for c in (16, 1 << 20))
    assert one == two


def test_texts_fall_into_about_as_many_pieces_as_the_library_gives(vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["Sharks have roamed the oceans for hundreds of millions of years, long before trees grew on land.", "Der schnelle Fuchs springt über den faulen Hund, und niemand sieht ihn."]
    own, theirs = (sum(map(len, x)) for x in ([vocabulary.encode(" " + t) for t in texts], [library.encode(t) for t in texts]))
    assert abs(own / theirs - 1) < 0.1


def test_different_words_of_a_text_are_solved_together(vocabulary, monkeypatch):
    r = random.Random(4)
    names = ["the", "ing", "tion", "é", "漢", "😀", "▁", "q", "--", "\u0000", "ß", "<s>", "\t", "  "]
    words = list({"".join(r.choice(names) for _ in range(r.randint(1, 12))) for _ in range(4000)})
    text = " " + " ".join(words) + " " + "=" * 500
    want = np.frombuffer(b"".join(vocabulary.solve(u)[1] for u in vocabulary.unit.findall(text)), np.uint32).tolist()
    calls, alone = [], pieces.Vocabulary.solve
    monkeypatch.setattr(pieces.Vocabulary, "solve", lambda self, unit: calls.append(unit) or alone(self, unit))
    assert vocabulary.encode(text).tolist() == want
    assert len(calls) < 200


def test_lists_of_texts_are_those_of_each(vocabulary):
    texts = pa.array([None, "", " a", "", "\n", " a b " * 300, None, "é" * 400, *[f"x{i} ▁{i}" for i in range(500)], ""])
    got = vocabulary.encode_all(texts[1:])
    assert got.to_pylist() == [vocabulary.encode(t or "").tolist() for t in texts[1:].to_pylist()]
    assert vocabulary.encode_all(texts[:0]).to_pylist() == [] and vocabulary.encode_all(texts[:1]).to_pylist() == [[]]


def test_a_batch_is_encoded_once_if_its_ids_are_decoded_too(vocabulary, monkeypatch):
    class Held:
        value = vocabulary

    calls, own = [], pieces.Vocabulary.encode_all
    monkeypatch.setattr(pieces.Vocabulary, "encode_all", lambda self, texts: calls.append(len(texts)) or own(self, texts))
    one, two = pa.array(["a b", None, ""]), pa.array(["a b", None, "c"])
    first, again, other = (pieces._once(Held, "test", x) for x in (one, pa.array(one.to_pylist()), two))
    assert first.equals(again) and not first.equals(other) and calls == [3, 3]
    assert other.to_pylist() == [vocabulary.encode(" a b").tolist(), [], vocabulary.encode(" c").tolist()]


def test_ids_that_spell_no_text_are_decoded_all_the_same(vocabulary):
    lists = pa.array([[vocabulary.bytes_[0x20], vocabulary.bytes_[0xFF]], None, [], [vocabulary.ids[" a"]], [vocabulary.ids["a"]]], pa.list_(pa.int32()))
    assert pieces.Speller.of(vocabulary).decode(lists).to_pylist() == ["\ufffd", "", "", "a", ""]


def test_groups_of_little_data_are_dealt_to_as_many_tasks_as_asked(spark):
    rows = spark.range(40).selectExpr("id % 20 AS g", "id")
    out = grouped(rows, ["g"], lambda t: t.slice(0, 1), "g long, id long", 4)
    assert out.rdd.getNumPartitions() == 4 and sorted(r["g"] for r in out.collect()) == list(range(20))

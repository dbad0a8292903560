"""Toxicity by class-conditional Kneser-Ney models.

Two models over the bytes of words, one of toxic and one of ordinary documents,
share their lower orders: the top order has counts of its class, discounted, and
backs off to Kneser-Ney continuation counts of both.  What neither class has seen
often is then equally likely in both, and only real differences speak.  Evidence
is the difference of both log-likelihoods per word: of the whole document, and of
its strongest words, so that a few words count in a long text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnp
from .common import cuts, fold, give_back, id_crc, replace, sliced, small_batches, words
from .labels import sampled

MOST_TRAIN = 2_500  # labelled documents of each class to learn from, about
THRESHOLD = 0.3
ORDER = 6  # bytes, so that an n-gram fits a 64-bit integer
DISCOUNT, TOP_DISCOUNT = 0.75, 0.75
FOLDS = 4
LONGEST = 64  # bytes of a word that are counted at once; longer words in pieces
STRONGEST = 3  # words of a document
AT_ONCE = 50_000  # words whose n-grams the driver counts at once
CACHED = 400_000  # words whose evidence a worker keeps
PAD = 0x20


@dataclass
class Evidence:
    """log P(byte | 5 bytes before) of toxic less ordinary: of seen n-grams, else of seen contexts, else 0."""

    grams: np.ndarray
    gram_values: np.ndarray
    contexts: np.ndarray
    context_values: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        return _look(self.grams, self.gram_values, keys, _look(self.contexts, self.context_values, keys >> np.uint64(8), 0.0))


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: np.ndarray | float) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(np.asarray(other, float), wanted.shape)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def grams(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of each word with its end, A-Z as a-z, before it only blanks; and where each word's begin."""
    size = end - begin
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(size + 1)])
    which = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(first[-1]) - first[:-1][which]
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    last = place == size[which]
    at = np.minimum(begin[which] + place, max(0, len(data) - 1))
    codes = np.where(last, PAD, low[data[at]] if len(data) else PAD).astype(np.uint64)
    key = codes.copy()
    for back in range(1, ORDER):
        shifted = np.full(len(codes), PAD, np.uint64)
        shifted[back:] = codes[:-back]
        key |= np.where(place >= back, shifted, np.uint64(PAD)) << np.uint64(8 * back)
    return key, first


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted contexts of n-gram keys, their counts in all, and how many different bytes follow."""
    contexts, back = np.unique(keys >> np.uint64(8), return_inverse=True)
    return contexts, np.bincount(back, counts, len(contexts)), np.bincount(back, counts > 0, len(contexts))


def _shared(keys: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of the last byte of top-order keys after ORDER - 2 bytes, from continuation counts."""
    levels, seen = [], keys
    for n in range(ORDER - 1, 0, -1):
        seen, counts = np.unique(seen & np.uint64((1 << (8 * n)) - 1), return_counts=True)
        levels.append((seen, counts.astype(float)))
    p = np.full(len(keys), 1 / 257)
    for n, (seen, counts) in zip(range(1, ORDER), reversed(levels), strict=True):
        own = keys & np.uint64((1 << (8 * n)) - 1)
        contexts, total, kinds = _totals(seen, counts)
        t = _look(contexts, total, own >> np.uint64(8), 0.0)
        k = _look(contexts, kinds, own >> np.uint64(8), 0.0)
        c = _look(seen, counts, own, 0.0)
        p = np.where(t > 0, (np.maximum(c - DISCOUNT, 0) + DISCOUNT * k * p) / np.maximum(t, 1), p)
    return p


def learn(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Evidence:
    """Evidence of distinct n-gram keys with their counts in either class."""
    used = (toxic > 0) | (ordinary > 0)
    keys, toxic, ordinary = keys[used], toxic[used].astype(float), ordinary[used].astype(float)
    p = _shared(keys)
    contexts = np.unique(keys >> np.uint64(8))
    logs, backs = [], []
    for counts in (toxic, ordinary):
        own, total, kinds = _totals(keys, counts)
        back = np.where(total > 0, TOP_DISCOUNT * kinds / np.maximum(total, 1e-9), 1.0)
        t = np.maximum(_look(own, total, keys >> np.uint64(8), 0.0), 1e-9)
        logs.append(np.log(np.maximum(counts - TOP_DISCOUNT, 0) / t + _look(own, back, keys >> np.uint64(8), 1.0) * p))
        backs.append(np.log(_look(own, back, contexts, 1.0)))
    return Evidence(keys, (logs[0] - logs[1]).astype(np.float32), contexts, (backs[0] - backs[1]).astype(np.float32))


@dataclass
class Model:
    evidence: Evidence
    weights: np.ndarray


_kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def word_evidence(evidence: Evidence, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, cache: str) -> np.ndarray:
    """Evidence of whole words, the sum over their bytes; a worker remembers those it has met."""
    known, values = _kept.get(cache, (np.zeros(0, np.uint64), np.zeros(0)))
    out = np.array(_look(known, values, hashes, np.nan))
    new = np.flatnonzero(np.isnan(out))
    for i in range(0, len(new), 50_000):
        some = new[i : i + 50_000]
        keys, first = grams(data, begin[some], end[some])
        sums = np.concatenate([np.zeros(1), np.cumsum(evidence.of(keys))])
        out[some] = sums[first[1:]] - sums[first[:-1]]
    if len(new):
        if len(known) + len(new) > CACHED:
            known, values, new = known[:0], values[:0], new[:CACHED]
        known, values = np.concatenate([known, hashes[new]]), np.concatenate([values, out[new]])
        order = np.argsort(known, kind="stable")
        if cache not in _kept and len(_kept) >= FOLDS:
            _kept.clear()
        _kept[cache] = known[order], values[order]
    return out


def measures(texts: pa.Array, evidence: Evidence, cache: str) -> np.ndarray:
    """For each text: evidence of its strongest different words, strongest first, and its mean; 0 where there are none."""
    data, at = textnp.raw(texts)
    begin, end, first = textnp.spans(data, at)
    hashes = textnp.word_hashes(data, begin, end)
    kinds, one, back = np.unique(hashes, return_index=True, return_inverse=True)
    value = word_evidence(evidence, kinds, data, begin[one], end[one], cache)
    out = np.zeros((len(texts), STRONGEST + 1))
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if b > a:
            mine = back[a:b]
            top = np.sort(value[np.unique(mine)])[: -STRONGEST - 1 : -1]
            out[i, : len(top)] = np.maximum(top, 0)
            out[i, STRONGEST] = value[mine].mean()
    return out


def design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x[:, 0], x[:, :2].mean(1), x[:, :STRONGEST].mean(1), x[:, STRONGEST]])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-4
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - keep * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, g)
        w += step * min(1, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counted(table: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of some words (word, inner, open), in order, and their counts, a row for each of the columns."""
    data, at = textnp.raw(table["word"])
    every, first = grams(data, at[:-1], at[1:])
    inner, open_ = (table[n].to_numpy() for n in ("inner", "open"))
    lengths = np.diff(first) - (ORDER - 1) * inner - open_
    every = np.delete(every, np.concatenate([(first[:-1][inner][:, None] + np.arange(ORDER - 1)).ravel(), first[1:][open_] - 1]))
    keys, back = np.unique(every, return_inverse=True)
    owner = np.repeat(np.arange(len(at) - 1), lengths)
    return keys, np.stack([np.bincount(back, table[n].to_numpy()[owner], len(keys)).astype(np.int32) for n in names])


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", most: int = MOST_TRAIN) -> Model:
    """Learns from about `most` usable labelled documents of each class at most.

    Spark counts in how many documents of each class and fold each word stands;
    those counts come to the driver, bounded by the sample.  The weights of the
    measures are fitted on documents that the model behind their measures has not
    seen.  Without usable rows every score is the same.
    """
    sc = docs.sparkSession.sparkContext
    rows = sampled(docs, labels, label, usable, most).withColumn("fold", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int"))
    sizes = {r["y"]: r["n"] for r in labels.where(F.col(label).isin(0, 1) & usable).groupBy(F.col(label).cast("int").alias("y")).agg(F.count_distinct("doc_id").alias("n")).collect()}
    each = rows.select("y", "fold", F.explode(F.transform(F.array_distinct(words(fold(F.col("text")))), lambda w: w.cast("binary"))).alias("whole"))
    # pieces share as many bytes as an n-gram has before its last, so each n-gram of a word is in one piece
    size, step = F.octet_length("whole"), LONGEST - ORDER + 1
    pieces = F.greatest(F.lit(1), F.ceil((size - ORDER + 1) / step).cast("int"))
    each = each.select("y", "fold", "whole", pieces.alias("pieces"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("no"))
    each = each.select("y", "fold", F.substring("whole", F.col("no") * step + 1, F.lit(LONGEST)).alias("word"), (F.col("no") > 0).alias("inner"), (F.col("no") + 1 < F.col("pieces")).alias("open"))
    names = [(k, f) for k in (0, 1) for f in range(FOLDS)]
    table = each.groupBy("word", "inner", "open").agg(*(F.count(F.when((F.col("y") == k) & (F.col("fold") == f), 1)).cast("int").alias(f"c{k}{f}") for k, f in names)).toArrow()
    keys, counts = np.zeros(0, np.uint64), np.zeros((len(names), 0), np.int32)
    old = each = some = both = back = None
    for lo in range(0, table.num_rows, AT_ONCE):
        some, each = _counted(table.slice(lo, AT_ONCE), [f"c{k}{f}" for k, f in names])
        both, back = np.unique(np.concatenate([keys, some]), return_inverse=True)
        old, counts = counts, np.zeros((len(names), len(both)), np.int32)
        counts[:, back[: len(keys)]] = old
        counts[:, back[len(keys) :]] += each
        keys = both
    del table, old, each, some, both, back
    counts = dict(zip(names, counts, strict=True))
    of = lambda k, without: sum(counts[k, f] for f in range(FOLDS) if f != without)
    cache = uuid.uuid4().hex
    folds = sc.broadcast([learn(keys, of(1, f), of(0, f)) for f in range(FOLDS)])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            for f in range(FOLDS):
                part = b.filter(pa.compute.equal(b.column("fold"), f))
                if part.num_rows:
                    x = measures(part.column("text"), folds.value[f], f"{cache}/{f}")
                    yield pa.RecordBatch.from_arrays([part.column("y"), part.column("doc_id"), *map(pa.array, x.T)], ["y", "doc_id", *(f"x{i}" for i in range(x.shape[1]))])

    with small_batches(docs.sparkSession):
        got = rows.select("y", "doc_id", "fold", "text").mapInArrow(measured, "y int, doc_id long, " + ", ".join(f"x{i} double" for i in range(STRONGEST + 1))).toPandas().sort_values(["doc_id", "y"])
    folds.destroy()
    y = got["y"].to_numpy()
    weight = np.ones(len(y))
    for k in (0, 1):
        weight[y == k] = max(1.0, sizes.get(k, 0) / max(1, (y == k).sum()))
    x = design(got[[f"x{i}" for i in range(STRONGEST + 1)]].to_numpy(float))
    model = Model(learn(keys, of(1, None), of(0, None)), logistic(x, y, weight / weight.mean() if len(y) else weight))
    del keys, counts, got
    give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score double (0 to 1) and predicted int to documents (text, ...); null text scores as empty text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it learned from
    cache = uuid.uuid4().hex

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        x = design(np.concatenate([np.zeros((0, STRONGEST + 1)), *(measures(text[a:b], held.value.evidence, cache) for a, b in cuts(text))]))
        pa.default_memory_pool().release_unused()
        return pa.array(1 / (1 + np.exp(-np.clip(x @ held.value.weights, -30, 30))), pa.float64())

    out = replace(docs, score=scored(F.col("text")))
    return replace(out, predicted=(F.col("score") >= THRESHOLD).cast("int"))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id mod 4 is 2."""
    return id_crc(doc_id) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_TRAIN) -> DataFrame:
    """Adds held_out boolean, score double and predicted int to documents (doc_id, text, ...).

    Learns from labels (doc_id, toxic) of rows that aren't held out.  All rows
    stay, repeated ones too, and score alike; very long texts and words are read
    whole.  Null and empty texts score as empty text; equal texts score alike; a null id is held out or not as empty text is.  Input columns with an output's
    name give way; an empty table stays empty.
    """
    model = train(docs, labels, ~held_out(F.col("doc_id")), label, most)
    return score(replace(docs, held_out=held_out(F.col("doc_id"))), model)

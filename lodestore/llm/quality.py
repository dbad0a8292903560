"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted feature by feature, in cycles; the sum of a feature's
trees is a lookup table over its bins.  Pairs that explain what is left get tables
of their own.  A score is the sum of one entry of each table, through a logistic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnp
from .common import cuts, id_crc, replace, sliced, small_batches
from .labels import sampled

MOST_TRAIN = 10_000  # labelled rows of each class to learn from, about
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAST, RIDGE = 64, 12, 6, 120, 60, 0.15, 4, 2.0
FEATURES = ("log_words", "word_bytes", "upper", "symbols", "marks", "digits", "same_as_last", "distinct", "repeated", "line_words", "odd_ends", "no_letters", "non_ascii", "stops")


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of distinct hashes in each text."""
    out = np.zeros(len(first) - 1)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        part = np.sort(hashes[a:b])
        out[i] = (b > a) + np.count_nonzero(part[1:] != part[:-1])
    return out


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, LOWER = _class(bytes(range(65, 91))), _class(bytes(range(97, 123)))
DIGITS, HIGH, STOPS = _class(b"0123456789"), _class(bytes(range(128, 256))), _class(b".,;:?")
MARKS, SYMBOLS = _class(b"!"), _class(b"#$%&*+/<=>@[\\]^_`{|}~")


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, over the whole text."""
    data, at = textnp.raw(texts)
    begin, end, first = textnp.spans(data, at)
    hashes = textnp.word_hashes(data, begin, end)
    runs, run_at = textnp.shingles(hashes, first, 6)
    words, size = np.diff(first).astype(float), np.diff(at).astype(float)
    some, full = np.maximum(words, 1), np.maximum(size, 1)
    upper, lower, high = _sums(UPPER[data], at), _sums(LOWER[data], at), _sums(HIGH[data], at)
    inside = np.ones(len(hashes), bool)
    inside[first[:-1][words > 0]] = False
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    letters = np.concatenate([np.zeros(1, np.int64), np.cumsum((UPPER | LOWER | HIGH)[data], dtype=np.int64)])
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    n_runs = np.maximum(np.diff(run_at), 1)
    columns = [
        np.log1p(words),
        _sums(end - begin, first) / some,
        upper / np.maximum(upper + lower, 1),
        _sums(SYMBOLS[data], at) / full,
        _sums(MARKS[data], at) / some,
        _sums(DIGITS[data], at) / full,
        _sums(same & inside, first) / some,
        _distinct(hashes, first) / some,
        1 - _distinct(runs, run_at) / n_runs,
        np.log1p(words / (1 + _sums(data == 10, at))),
        _sums((SYMBOLS | MARKS)[last], first) / some,
        _sums(letters[end] == letters[begin], first) / some,
        high / full,
        _sums(STOPS[data], at) / some,
    ]
    return np.column_stack(columns)


@dataclass
class Gam:
    """Bin edges and tables; score() adds one entry of each table."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, j], "right")]
        for i, j, a, b, table in self.pairs:
            out += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Edges between about equally full bins."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher")) if len(values) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The best place to part bins in two, and what it gains."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = np.where((nl >= LEAST) & (n.sum() - nl >= LEAST), _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum()), -1.0)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """What a shallow tree over the bins adds to each bin."""
    gain, k = _split(g, h, n) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:k], h[:k], n[:k], depth - 1), _tree(g[k:], h[k:], n[k:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that parts one axis, then each part along the other; its gain and what it adds to each cell."""
    best, out = -1.0, np.zeros_like(g)
    for turn in (False, True):
        a, b, c = (g.T, h.T, n.T) if turn else (g, h, n)
        for k in range(1, len(a)):
            got, add = 0.0, np.zeros_like(a)
            for rows in (slice(0, k), slice(k, len(a))):
                line = a[rows].sum(0), b[rows].sum(0), c[rows].sum(0)
                gain, m = _split(*line)
                cuts = [slice(0, None)] if gain <= 0 else [slice(0, m), slice(m, None)]
                for cols in cuts:
                    got += _gain(line[0][cols].sum(), line[1][cols].sum())
                    add[rows, cols] = line[0][cols].sum() / (line[1][cols].sum() + RIDGE)
            if got > best:
                best, out = got, add.T if turn else add
    return best, out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Gam:
    """Boosts tables on rows x with labels y (0 or 1); rows count by weight."""
    y = y.astype(float)
    mean = min(max(float(np.average(y, weights=weight)) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Gam(float(np.log(mean / (1 - mean))), [], [], [])
    if not len(y):
        return model
    width = x.shape[1]
    model.edges = [_edges(x[:, j], BINS) for j in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    full = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    logit = np.full(len(y), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return (y - p) * weight, np.maximum(p * (1 - p), 1e-6) * weight

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = slopes()
            add = RATE * _tree(np.bincount(bins[j], g, len(full[j])), np.bincount(bins[j], h, len(full[j])), full[j], 2)
            model.tables[j] += add
            logit += add[bins[j]]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(width)]
    cells = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]

    def grid(i: int, j: int, values: np.ndarray | None) -> np.ndarray:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(cells[i] * shape[1] + cells[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(combinations(range(width), 2), key=lambda p: -_pair_tree(grid(*p, g), grid(*p, h), grid(*p, None))[0])
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, table in model.pairs:
            g, h = slopes()
            add = RATE * _pair_tree(grid(i, j, g), grid(i, j, h), grid(i, j, None))[1]
            table += add
            logit += add[cells[i], cells[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", most: int = MOST_TRAIN) -> Gam:
    """Learns from about `most` usable labelled documents of each class at most.

    Only features of those rows, a few numbers each, come to the driver.  Classes
    that were thinned out count by as much more, so scores stay probabilities.
    Without usable rows every score is 0.5.
    """
    rows = sampled(docs, labels, label, usable, most)
    sizes = {r["y"]: r["n"] for r in labels.where(F.col(label).isin(0, 1) & usable).groupBy(F.col(label).cast("int").alias("y")).agg(F.count_distinct("doc_id").alias("n")).collect()}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("doc_id"), *map(pa.array, x.T)], ["y", "doc_id", *FEATURES])

    with small_batches(docs.sparkSession):
        got = rows.select("y", "doc_id", "text").mapInArrow(measured, "y int, doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas().sort_values(["doc_id", "y"])
    y = got["y"].to_numpy()
    weight = np.ones(len(y))
    for k in (0, 1):
        weight[y == k] = max(1.0, sizes.get(k, 0) / max(1, (y == k).sum()))
    return fit(got[list(FEATURES)].to_numpy(float), y, weight / weight.mean() if len(y) else weight)


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """Adds score double (0 to 1) and predicted int to documents (text, ...); null text scores as empty text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of fixed size

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(held.value.score(features(text[a:b])) for a, b in cuts(text))]), pa.float64())

    out = replace(docs, score=scored(F.col("text")))
    return replace(out, predicted=(F.col("score") >= THRESHOLD).cast("int"))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id mod 5 is 0."""
    return id_crc(doc_id) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_TRAIN) -> DataFrame:
    """Adds held_out boolean, score double and predicted int to documents (doc_id, text, ...).

    Learns from labels (doc_id, quality) of rows that aren't held out.  All rows
    stay, repeated ones too, and score alike; very long texts and words are read
    whole.  Null and empty texts score as empty text; equal texts score alike; a null id is held out or not as empty text is.  Input columns with an output's
    name give way; an empty table stays empty.
    """
    model = train(docs, labels, ~held_out(F.col("doc_id")), label, most)
    return score(replace(docs, held_out=held_out(F.col("doc_id"))), model)

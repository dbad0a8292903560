"""Language-model scoring with a weighted backoff automaton of words, word pairs and word triples.

Every n-gram that was counted, of up to three words, is a state of an automaton and,
by its last word, an arc out of the state of the words before it.  A failure arc
leads from each state to that of the words without their first, down to the root,
whose arcs are the words.  A text is one traversal from left to right: at each token
the state is the longest n-gram seen that ends there, and the next word takes the
arc of the first state down the failure arcs that has one.

Smoothing is hierarchical: a state that was seen c times gives an arc that was seen
n times (n + s * p) / (c + s), where p is what the state below gives the word and s
is the order's strength; the failure arc weighs s / (c + s).  So weights need no more
than counts, and the probabilities after each state sum to one.

No part of the automaton is held in one place, and no n-gram is left out.  Tokens
are packed in blocks of bounded size.  A block asks for the counts of its different
n-grams, in lists by ranges of their hashes; the lists of one range meet in a task,
which adds the counts of the training tokens up and answers each list.  A frequent
n-gram occurs once in a list, however often it is in the text, so no task gets more
of it than there are blocks.

Words are told apart by 64-bit hashes of their bytes, pairs and triples by SPARE bits
more than it takes to number them: one that was never seen is taken for another with
a chance of about one in a million, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnp
from .common import cut, cut_by, grouped, id_crc, sliced, small_batches, spread

STRENGTHS = (300.0, 5.0)  # of states of one word and of two
BLOCK = 1 << 21  # tokens in a block, at most
SPARE = 20
PART = 1 << 22  # asked n-grams that meet in a task, at most about
END = np.uint64(0)  # the end of a text, in place of a word's hash
CARRIED = len(STRENGTHS)  # tokens before a part of a text that its first tokens depend on


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id mod 5 is 1."""
    return id_crc(doc_id) % 5 == 1


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z as a-z, with one end after each text; and where each text's tokens begin."""
    data, at = textnp.raw(texts)
    begin, end, first = textnp.spans(data, at)
    hashes = textnp.word_hashes(data, begin, end)
    hashes[hashes == END] = np.uint64(1)
    return np.insert(hashes, first[1:], END), first + np.arange(len(first))


def _joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hashes of n-grams by the hashes of all but their last word, and of that."""
    return textnp.mix(one * np.uint64(0xD1342543DE82EF95) + textnp.mix(two + np.uint64(0x9E3779B97F4A7C15)))


def ngrams(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each token its pair and its triple; a text begins after an end, and there, where it has no triple yet, the pair stands in its place."""
    starts = first[:-1]
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[starts] = END
    pairs = _joined(before, hashes)
    triples = np.empty_like(pairs)
    triples[1:] = _joined(pairs[:-1], hashes[1:])
    triples[starts] = pairs[starts]
    return [pairs, triples]


def packed_keys(keys: np.ndarray, low: int) -> bytes:
    """Ascending keys, none below `low`, by their distances, in as few bytes each as the largest needs; the highest of these, mostly small, is compressed."""
    gaps = np.diff(keys, prepend=np.uint64(low))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    each = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    return bytes([width]) + each[:, : width - 1].tobytes() + compress(each[:, width - 1].tobytes(), 1)


def unpacked_keys(data: bytes, low: int, n: int) -> np.ndarray:
    width = data[0]
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : width - 1] = np.frombuffer(data, np.uint8, n * (width - 1), 1).reshape(n, width - 1)
    wide[:, width - 1] = np.frombuffer(decompress(data[1 + n * (width - 1) :]), np.uint8)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64) + np.uint64(low)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts as one byte each; those of 255 and more follow behind; all compressed."""
    return compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes(), 1)


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    data = decompress(data)
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


PIECES = "array<struct<r:long,doc_id:{kind},train:boolean,at:int,skip:int>>"


def _pack(docs: DataFrame, usable: Column, block: int) -> DataFrame:
    """(block, n, n_train, n_texts, pieces, words, codes), a row for each block.

    pieces: the texts' parts, where their tokens begin, and how many of these were
    tokens of the part before already.  words: hashes of the block's different words,
    the most frequent first; codes: each token's place among them, byte by byte from
    the lowest on, compressed.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"block long, n long, n_train long, n_texts long, pieces {PIECES.format(kind=kind)}, words binary, codes binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36  # numbers of rows and blocks of this partition
        row = no = held = 0
        parts: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal no, held
            sizes = [len(p[4]) for p in parts]
            words, codes, times = np.unique(np.concatenate([p[4] for p in parts]), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(words), "<u4")
            place[order] = np.arange(len(words))
            codes = place[codes].view(np.uint8).reshape(-1, 4).T
            new = sum(n - p[3] for p, n in zip(parts, sizes, strict=True))
            learned = sum(n - p[3] for p, n in zip(parts, sizes, strict=True) if p[2])
            begun = sum(p[2] and p[3] == 0 for p in parts)
            at = np.cumsum([0, *sizes[:-1]])
            listed = [{"r": p[0], "doc_id": p[1], "train": p[2], "at": int(a), "skip": p[3]} for p, a in zip(parts, at, strict=True)]
            done = {"block": base + no, "n": new, "n_train": learned, "n_texts": begun, "pieces": listed, "words": words[order].tobytes(), "codes": compress(codes.tobytes(), 1)}
            parts.clear()
            no, held = no + 1, 0
            return pa.RecordBatch.from_pylist([done], schema=schema)

        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(layout)
        for b in sliced(batches, "text"):
            hashes, first = tokens(b.column("text"))
            ids, train = b.column("doc_id").to_pylist(), b.column("train").to_pylist()
            for i in range(b.num_rows):
                lo, skip = first[i], 0
                while lo + skip < first[i + 1]:
                    hi = min(first[i + 1], lo + skip + max(1, block - held))
                    parts.append((base + row, ids[i], bool(train[i]), int(skip), hashes[lo:hi]))
                    held += int(hi - lo)
                    if held >= block:
                        yield flush()
                    skip = min(CARRIED, hi - first[i])
                    lo = hi - skip
                row += 1
        if parts:
            yield flush()

    from pyspark.sql.types import StructType

    layout = StructType.fromDDL(out)
    rows = docs.select("doc_id", "text", usable.alias("train"))
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, 4 * rows.rdd.getNumPartitions())
    with small_batches(docs.sparkSession):
        return cut_by(rows.mapInArrow(pack, out), "block", buckets)


def _unpack(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray], list]:
    """Words of a block's row, each token's place among them, where its texts' parts begin, whether parts are learned from and how many tokens they skip, and (r, doc_id) of parts."""
    words = np.frombuffer(b.column("words")[i].as_buffer(), np.uint64)
    codes = np.frombuffer(decompress(b.column("codes")[i].as_buffer()), np.uint8).reshape(4, -1)
    codes = np.ascontiguousarray(codes.T).view("<u4").ravel()
    parts = b.column("pieces")[i].values
    first = np.append(parts.field("at").to_numpy(zero_copy_only=False).astype(np.int64), len(codes))
    each = {"train": parts.field("train").to_numpy(zero_copy_only=False), "skip": parts.field("skip").to_numpy(zero_copy_only=False).astype(np.int64)}
    return words, codes, first, each, [parts.field("r"), parts.field("doc_id")]


def _fresh(first: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Which tokens of a block aren't repeated from the part before."""
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first)) >= np.repeat(skip, np.diff(first))


def _kept(keys: np.ndarray, width: int) -> np.ndarray:
    """Keys by their highest bits, so many."""
    return keys & ~np.uint64((1 << (64 - width)) - 1)


def _asked(blocks: DataFrame, bits: int, width: int) -> DataFrame:
    """(part, block, n, keys, counts): the different words (even parts) and n-grams (odd ones) of each block, by ranges of their hashes, and how often its training tokens have them."""
    low = [p << (64 - bits) for p in range(1 << bits)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words, codes, first, each, _ = _unpack(b, i)
                counted = _fresh(first, each["skip"]) & np.repeat(each["train"], np.diff(first))
                again = counted.copy()
                again[first[:-1]] = False  # the pair that stands for a triple counts once
                keys, where = np.unique(_kept(np.concatenate(ngrams(words[codes], first)), width), return_inverse=True)
                order = np.argsort(words)
                sides = [(words[order], np.bincount(codes[counted], minlength=len(words))[order]), (keys, np.bincount(where[np.concatenate([counted, again])], minlength=len(keys)))]
                block = b.column("block")[i].as_py()
                for odd, (k, c) in enumerate(sides):
                    cuts = np.concatenate([[0], np.searchsorted(k, np.array(low[1:], np.uint64)), [len(k)]])
                    full = np.flatnonzero(np.diff(cuts))
                    lists = [(packed_keys(k[cuts[p] : cuts[p + 1]], low[p]), packed_counts(c[cuts[p] : cuts[p + 1]])) for p in full]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(2 * full + odd, pa.int64()), pa.array([block] * len(full), pa.int64()), pa.array(np.diff(cuts)[full], pa.int64()), pa.array([x for x, _ in lists], pa.binary()), pa.array([x for _, x in lists], pa.binary())],
                        ["part", "block", "n", "keys", "counts"],
                    )

    return spread(blocks.select("block", "pieces", "words", "codes")).mapInArrow(ask, "part long, block long, n long, keys binary, counts binary")


def _answered(asked: DataFrame, bits: int) -> DataFrame:
    """(block, part, counts, kinds): how often all training tokens have a list's words or n-grams; kinds: different training words of the range, with its first list."""

    def add(t: pa.Table) -> pa.Table:
        part, sizes = t["part"][0].as_py(), t["n"].to_pylist()
        low = (part >> 1) << (64 - bits)
        given = np.concatenate([unpacked_counts(c, n) for c, n in zip(t["counts"].to_pylist(), sizes, strict=True)])
        keys, where = np.unique(np.concatenate([unpacked_keys(k, low, n) for k, n in zip(t["keys"].to_pylist(), sizes, strict=True)]), return_inverse=True)
        total = np.rint(np.bincount(where, given, len(keys))).astype(np.int64)
        kinds = np.zeros(len(sizes), np.int64)
        kinds[0] = 0 if part & 1 else np.count_nonzero(total)
        at = np.cumsum([0, *sizes])
        counts = [packed_counts(total[where[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"block": t["block"], "part": t["part"], "counts": pa.array(counts, pa.binary()), "kinds": kinds})

    return grouped(asked, ["part"], add, "block long, part long, counts binary, kinds long")


def _found(keys: np.ndarray, bits: int, lists: list[bytes]) -> np.ndarray:
    """The counts of ascending keys in the answers to their lists, which are in order."""
    sizes = np.bincount((keys >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate([unpacked_counts(c, int(n)) for c, n in zip(lists, sizes[sizes > 0], strict=True)])


def traverse(root: np.ndarray, arcs: Sequence[np.ndarray], states: Sequence[np.ndarray], strengths: Sequence[float] = STRENGTHS) -> np.ndarray:
    """log10 weight of each token: the root's, and for the orders above how often arc and state were seen (0: not there).

    A token takes the arc of its state if there is one, else the failure arc and what
    the state below gives it.
    """
    weight = np.log10(root)
    for arc, state, s in zip(arcs, states, strengths, strict=True):
        down = np.log10(s / (state + s)) + weight
        weight = np.where(arc > 0, np.log10((arc + s * 10.0**weight) / (state + s)), down)
    return weight


def score(docs: DataFrame, usable: Column | None = None, strengths: Sequence[float] = STRENGTHS, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each document (doc_id, text, ...).

    Learns from the rows that usable picks, else those not held out.  base_score:
    log10 probability by additively smoothed single words; score: by the automaton.
    block, part: how much meets in a task, which doesn't change a result.  Null and
    empty texts are one token, the end.  Repeated rows have a result each, the same
    one.  Without training rows all tokens are unknown.  Very long texts are scored
    in parts, each with the words before it.  Other columns are not looked at; an
    empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = _pack(docs, F.coalesce(~held_out(F.col("doc_id")) if usable is None else usable, F.lit(False)), block)
    n, total, texts = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_train", "n_texts"))).first()
    bits = max(1, (-(-2 * n // part) - 1).bit_length())
    width = min(64, max(40, (2 * n).bit_length() + SPARE))
    answers = cut(_answered(_asked(blocks, bits, width), bits))
    kinds = answers.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    mass = total + 0.5 * (kinds + 1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words, codes, first, each, names = _unpack(b, i)
                lists = b.column("answers")[i].values
                odd = lists.field("part").to_numpy() & 1
                given = lists.field("counts").to_pylist()
                even, odd = ([c for c, x in zip(given, odd, strict=True) if x == side] for side in (0, 1))
                order = np.argsort(words)
                counts = np.empty(len(words), np.int64)
                counts[order] = _found(words[order], bits, even)
                one = counts[codes]
                keys, where = np.unique(_kept(np.concatenate(ngrams(words[codes], first)), width), return_inverse=True)
                two, three = _found(keys, bits, odd)[where].reshape(2, -1)
                starts = first[:-1]
                three[starts] = 0  # a text's first token has no triple
                above = [np.empty_like(one), np.empty_like(two)]
                above[0][1:], above[1][1:] = one[:-1], two[:-1]
                above[0][starts], above[1][starts] = texts, 0
                root = (one + 0.5) / mass
                fresh = _fresh(first, each["skip"])
                which = np.repeat(np.arange(len(starts)), np.diff(first))[fresh]
                sums = [np.bincount(which, x[fresh], len(starts)) for x in (np.log10(root), traverse(root, [two, three], above, strengths))]
                known = np.bincount(which[one[fresh] > 0], minlength=len(starts))
                yield pa.RecordBatch.from_arrays([*names, pa.array(np.bincount(which, minlength=len(starts))), pa.array(known), *map(pa.array, sums)], ["r", "doc_id", "n_tokens", "n_known", "base_score", "score"])

    listed = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "counts"))).alias("answers"))
    both = blocks.select("block", "pieces", "words", "codes").join(listed, "block")
    rows = both.mapInArrow(walk, f"r long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    sums = rows.groupBy("r").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return sums.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")

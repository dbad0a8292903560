"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is cut into the pieces of a vocabulary so that their scores sum to the most
(Viterbi).  No piece runs across the start of a word, so texts fall apart into
words; the different ones of a few MB of text are solved together, with numpy, place
by place from their ends.  Giant texts are split into chunks
anywhere: each chunk yields a transfer matrix, the best score from every state at
its left edge to every state at its right edge, where a state says how far a piece
reaches over the edge.  Matrices combine associatively under (max, +); a scan from
the right gives what every state at an edge can still reach, from which a chunk knows
which state it leads on to; these maps give the state at each edge, and the chunks
are then traced on their own.

Of cuttings with equal scores the one whose first piece is longest is taken, then
whose second is, and so on.  Scores are multiples of 2**-16, so sums are exact in
any order and a text's ids don't depend on whether or where it is split.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import log
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp
from .common import aside, cut, cuts, give_back, grouped, replace, sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768  # characters
AT_ONCE = 1 << 22  # bytes of text whose words are solved together
FEW = 128  # places that fewer words have than this are left to plain Python
OFFSET = 100.0  # added to the ranks of pieces
BLOCK = 1 << 14  # words that stand side by side
NONE = -np.inf
BLANK = "▁"


@dataclass
class Trie:
    """The bytes of pieces: byte c leads from node s to base[s] + c, if that node's owner is s; node 0 is the root."""

    base: np.ndarray
    owner: np.ndarray
    score: np.ndarray  # of the piece that ends at a node, if any
    ids: np.ndarray  # its id, else -1
    deepest: int

    @classmethod
    def of(cls, v: Vocabulary) -> Trie:
        spelled = {p.encode(): p for p in v.score if p}
        below: dict[bytes, set[int]] = {b"": set()}
        for p in spelled:
            for n in range(len(p)):
                below.setdefault(p[:n], set()).add(p[n])
        # nodes with many children choose their places first, the others fill the gaps
        free, low, placed, window = np.ones(1 << 16, bool), 256, {}, 4096
        free[:256] = False
        for name, children in sorted(below.items(), key=lambda x: (-len(x[1]), x[0])):
            some, at = sorted(children), low
            while True:
                if at + window + 256 > len(free):
                    free = np.concatenate([free, np.ones(len(free), bool)])
                fits = free[at : at + window].copy()
                for c in some[1:]:
                    fits &= free[at + c - some[0] : at + c - some[0] + window]
                first = int(fits.argmax())
                if fits[first]:
                    break
                at += window
            placed[name] = at + first - some[0] if some else 0
            free[[placed[name] + c for c in some]] = False
            low += int(free[low : low + window].argmax()) if free[low : low + window].any() else window
        size = max(placed.values()) + 256
        out = cls(np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, NONE), np.full(size, -1, np.int32), max(map(len, spelled), default=0))
        where = {b"": 0} | {name + bytes([c]): placed[name] + c for name, children in below.items() for c in children}
        for name, at in where.items():
            if name in placed:
                out.base[at] = placed[name]
            if name:
                out.owner[at] = where[name[:-1]]
            if name in spelled:
                out.score[at], out.ids[at] = v.score[spelled[name]], v.ids[spelled[name]]
        return out


@dataclass
class Vocabulary:
    """Pieces with their ids and scores; characters without a piece are spelled in bytes."""

    score: dict[str, float]
    ids: dict[str, int]
    bytes_: list[int]
    unknown: float

    @cached_property
    def starts(self) -> dict[str, float | None]:
        """Score of every piece, and None for what only begins a longer piece."""
        return {p[:n]: None for p in self.score for n in range(1, len(p))} | self.score

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.score), default=1)

    @cached_property
    def trie(self) -> Trie:
        return Trie.of(self)

    @cached_property
    def alone(self) -> str:
        """Line ends and tabs, if no piece holds them."""
        return "".join(c for c in "\n\r\t" if not any(c in p for p in self.score))

    @cached_property
    def unit(self) -> re.Pattern[str]:
        """What can be solved on its own: blanks with the word after them; line ends and tabs, which no piece holds."""
        alone = self.alone
        return re.compile(f"[{alone}]| *[^ {alone}]+| +" if alone else " *[^ ]+| +")

    def reach(self, text: str, edge: int, wide: bool) -> list:
        """Best sums at the edge and the places behind it that a piece beginning before the edge can end on.

        wide: from each of the first places, a vector of one sum each; else from place 0.
        """
        k = self.longest
        sums = [np.full(k, NONE) if wide else NONE for _ in range(edge + k)]
        if wide:
            for i in range(k):
                sums[i][i] = 0.0
        else:
            sums[0] = 0.0
        for i in range(edge):
            here = sums[i]
            if not wide and here == NONE:
                continue
            for j in range(i + 1, min(len(text), i + k) + 1):
                s = self.score.get(text[i:j], self.unknown if j == i + 1 else None)
                if s is not None:
                    sums[j] = np.maximum(sums[j], here + s) if wide else max(sums[j], here + s)
        return sums[edge:]

    @cached_property
    def packed(self) -> dict[str, bytes]:
        """The id of every piece as 4 bytes."""
        return {p: pack("<I", i) for p, i in self.ids.items()}

    def spell(self, piece: str) -> bytes:
        """A piece's id, or those of its bytes, packed."""
        return self.packed.get(piece) or pack(f"<{len(piece.encode())}I", *(self.bytes_[b] for b in piece.encode()))

    def behind(self, text: str, n: int, ahead: np.ndarray | None = None) -> tuple[list[float], list[int]]:
        """For each place of the first n characters, and those behind them, the best sum to the end and where the best piece ends.

        ahead: sums to the end from the places that a piece may reach behind the n
        characters; else the text ends there.
        """
        get, single, unknown = self.starts.get, self.score.get, self.unknown
        rest = [0.0] if ahead is None else [float(x) for x in ahead]
        sums, to = [NONE] * n + rest, [n] * n
        top = n + len(rest) - 1
        for i in range(n - 1, -1, -1):
            best, end, j = single(text[i], unknown) + sums[i + 1], i + 1, i + 2
            while j <= top:
                own = get(text[i:j], False)
                if own is False or j > len(text):
                    break
                if own is not None:
                    own += sums[j]
                    if own >= best:
                        best, end = own, j
                j += 1
            sums[i], to[i] = best, end
        return sums, to

    def solve(self, text: str) -> tuple[float, bytes]:
        """Score and packed ids of a text; of cuttings with equal scores the one whose first piece is longest."""
        n = len(text)
        sums, to = self.behind(text, n)
        out, i, packed = [], 0, self.packed
        while i < n:
            piece = text[i : to[i]]
            out.append(packed.get(piece) or self.spell(piece))
            i = to[i]
        return sums[0], b"".join(out)

    def leads(self, body: str, ahead: str, rest: np.ndarray) -> np.ndarray:
        """The state at the right edge of body that the best way leads to from each state at its left edge; rest: what each state at the right edge can still reach."""
        text, n = body + ahead, len(body)
        starts = [m.start() for m in self.unit.finditer(text) if 0 < m.start() <= n]
        first = starts[-1] if starts else 0
        to = self.behind(text[first:], n - first, rest)[1]
        state = list(range(n - first + len(rest)))
        for i in range(n - first - 1, -1, -1):
            state[i] = state[to[i]]
        found = [max(0, s - (n - first)) for s in state]
        # every way passes the starts of units
        return np.array([found[0]] * self.longest if starts else found[: self.longest])

    def units(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where units begin in the bytes of texts that begin at given places: as `unit` finds them."""
        begins = np.zeros(len(data), bool)
        blank = data == 0x20
        begins[1:] = blank[1:] & ~blank[:-1]
        for c in self.alone:
            same = data == ord(c)
            begins |= same
            begins[1:] |= same[:-1]
        begins[at[:-1][at[1:] > at[:-1]]] = True
        return np.flatnonzero(begins)

    def solve_all(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many units, given by their bytes and where each begins, one after another, and their number for each.

        The same cuttings as of solve().  Units stand side by side, aligned at their
        ends; a step finds for all of them how best to go on from the place so many
        bytes before the end, by walking the trie.
        """
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        most = int(size[order[FEW - 1]]) if len(size) >= FEW else 0
        ids, there = np.zeros(len(data), np.int32), np.zeros(len(data), bool)
        alone = int((size > most).sum())
        for u in order[:alone].tolist():
            got = np.frombuffer(self.solve(data[at[u] : at[u + 1]].tobytes().decode())[1], np.uint32)
            ids[at[u] : at[u] + len(got)], there[at[u] : at[u] + len(got)] = got, True
        for lo in range(alone, len(order), BLOCK):
            some = order[lo : lo + BLOCK]
            self._side_by_side(data, at[some + 1], size[some], ids, there)
        count = np.zeros(len(data) + 1, np.int64)
        np.cumsum(there, out=count[1:])
        return ids[there], np.diff(count[at])

    def _side_by_side(self, data: np.ndarray, ends: np.ndarray, size: np.ndarray, ids: np.ndarray, there: np.ndarray) -> None:
        """Marks where the pieces of units begin, and their ids; sizes in bytes, the largest first."""
        trie, top = self.trie, int(size[0])
        base, owner, score = trie.base, trie.owner, trie.score
        have = [int(np.searchsorted(-size, -p, "right")) for p in range(top + 1)]  # units with so many bytes
        up = np.concatenate([np.zeros(1, np.int64), np.cumsum(have)])
        step, node = np.ones(up[-1], np.uint8), np.zeros(up[-1], np.int32)
        sums, byte = [np.zeros(len(size))], [np.zeros(0, np.uint8)]
        for p in range(1, top + 1):
            n = have[p]
            byte.append(data[ends[:n] - p])
            to, best_node = step[up[p] : up[p + 1]], node[up[p] : up[p + 1]]
            best = sums[p - 1][:n] + self.unknown
            if byte[p].max() >= 0xC0:
                for k, (a, b) in {2: (0xC0, 0xE0), 3: (0xE0, 0xF0), 4: (0xF0, 0x100)}.items():
                    wide = np.flatnonzero((byte[p] >= a) & (byte[p] < b))
                    if k <= p and len(wide):
                        best[wide], to[wide] = sums[p - k][wide] + self.unknown, k
            now = base[0] + byte[p].astype(np.int32)
            live = np.flatnonzero(owner[now] == 0)
            now = now[live]
            for k in range(1, p + 1):
                own = score[now] + sums[p - k][live]
                won = np.flatnonzero(own >= best[live])  # later ones are longer
                if len(won):
                    at = live[won]
                    best[at], to[at], best_node[at] = own[won], k, now[won]
                if k == p:
                    break
                after = base[now] + byte[p - k][live]
                on = np.flatnonzero(owner[after] == now)
                live, now = live[on], after[on]
                if not len(live):
                    break
            sums.append(best)
        spelled = np.array(self.bytes_, np.int32)
        left, who = size, np.arange(len(size))
        while len(who):
            at = up[left] + who
            k, where = step[at].astype(np.int64), ends[who] - left
            found = trie.ids[node[at]]
            ids[where], there[where] = found, True
            bare = np.flatnonzero(found < 0)
            for j in range(int(k[bare].max()) if len(bare) else 0):
                place = where[bare[k[bare] > j]] + j
                ids[place], there[place] = spelled[data[place]], True
            left = left - k
            on = left > 0
            left, who = left[on], who[on]

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """Lists of ids of texts, as they stand; null and empty texts have none."""
        data, at = textnp.raw(texts)
        starts = self.units(data, at)
        edges = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, edges, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words, code = textnp.raw(units.dictionary), units.indices.to_numpy()
        ids, count = self.solve_all(*words)
        first = np.cumsum(count) - count
        n = count[code]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        where = np.repeat((first[code] - ends[:-1]).astype(np.int32), n)
        where += np.arange(ends[-1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends[np.searchsorted(starts, at)].astype(np.int32)), pa.array(ids[where], pa.int32()))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as it stands."""
        return self.encode_all(pa.array([text], pa.string())).values.to_numpy().astype(np.uint32)

    def transfer(self, body: str, ahead: str) -> np.ndarray:
        """Best sums from a piece's reach over the left edge of body to a piece's reach over its right edge.

        Every cutting has an edge at each start of a unit, so what lies between the
        first and the last of them adds the same to all sums, and is left out.
        """
        text, n = body + ahead, len(body)
        starts = [m.start() for m in self.unit.finditer(text) if 0 < m.start() <= n]
        if not starts:
            return np.stack(self.reach(text, n, True), 1)
        first, last = starts[0], starts[-1]
        head = self.reach(text[:first], first, True)[0]
        return head[:, None] + np.array(self.reach(text[last:], n - last, False))[None, :]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of transfer matrices (or stacks of them) under (max, +)."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(-2)


def scan(chunks: np.ndarray) -> np.ndarray:
    """Products of the last n, n - 1, ... matrices, in about log2 n rounds of independent combinations."""
    out, step, n = chunks.copy(), 1, len(chunks)
    while step < n:
        nxt = out.copy()
        for i in range(0, n - step, 64):  # a few at once, as products are large
            part = slice(i, min(i + 64, n - step))
            nxt[part] = combine(out[part], out[part.start + step : part.stop + step])
        out, step = nxt, step * 2
    return out


def rests(chunks: np.ndarray) -> np.ndarray:
    """What each state at the right edge of each chunk can still reach; at the end, state 0 is there."""
    end = np.where(np.arange(chunks.shape[1]) == 0, 0.0, NONE)
    return np.concatenate([scan(chunks)[1:, :, 0], end[None]])


def states(maps: np.ndarray) -> list[tuple[int, int]]:
    """State at the left and right edge of each chunk, by where each leads on to."""
    out, left = [], 0
    for m in maps:
        out.append((left, int(m[left])))
        left = int(m[left])
    return out


def load(path: str = MODEL, offset: float = OFFSET) -> Vocabulary:
    """A vocabulary file's pieces: normal ones with their scores, and its 256 byte pieces.

    Files of merged pieces have ranks in place of log-probabilities; sums of those
    mean nothing, so a piece of rank r scores -log(r + offset), as if its frequency
    followed the law of Zipf and Mandelbrot.  Nothing is learned from documents.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    score, ids, spelled = {}, {}, [0] * 256
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            spelled[int(piece[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            name = piece.replace(BLANK, " ")
            score[name], ids[name] = float(sp.get_score(i)), i
    known = [s for s in score.values() if s > -1e8]
    if known and all(s == int(s) for s in known):
        score = {p: -log(max(0.0, -s) + offset) if s > -1e8 else -log(len(score) + offset) for p, s in score.items()}
    score = {p: round(s * 65_536) / 65_536 for p, s in score.items()}
    return Vocabulary(score, ids, spelled, min(score.values()) - 10)


@dataclass
class Speller:
    """Bytes of each id."""

    parts: list[bytes]

    @classmethod
    def of(cls, v: Vocabulary) -> Speller:
        n = 1 + max([*v.ids.values(), *v.bytes_])
        parts = [b""] * n
        for p, i in v.ids.items():
            parts[i] = p.encode()
        for b, i in enumerate(v.bytes_):
            parts[i] = bytes([b])
        return cls(parts)

    @cached_property
    def table(self) -> pa.Array:
        return pa.array(self.parts, pa.large_binary())

    def decode(self, lists: pa.Array) -> pa.Array:
        """Texts of lists of ids; the blank in front of a text goes."""
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), 0)
        data, at = textnp.raw(self.table.take(lists.flatten()))
        edges = at[np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])]
        full = edges[1:] > edges[:-1]
        data, edges = np.delete(data, edges[:-1][full]), edges - np.concatenate([np.zeros(1, np.int64), np.cumsum(full)])
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:  # ids that spell no text
            return pa.array([t.decode(errors="replace") for t in texts.to_pylist()], pa.string())


_loaded: dict[str, Vocabulary] = {}


def _worker(held, token: str) -> Vocabulary:
    """This worker's copy of a vocabulary, with what it has derived from it."""
    if token not in _loaded:
        _loaded.clear()
        _loaded[token] = held.value
    return _loaded[token]


_last: list[tuple[str, pa.Array, pa.Array]] = []  # texts that this worker has encoded last, and their ids


def _once(held, token: str, texts: pa.Array) -> pa.Array:
    """Ids of a batch of texts, with a blank in front.

    Where ids and what is made of them are both asked for, Spark calls this twice for
    each batch, one after the other; the second call takes what the first has found.
    """
    if _last and _last[0][0] == token and _last[0][1].equals(texts):
        return _last.pop()[2]
    _last.clear()
    _last.append((token, texts, _encoded(_worker(held, token), texts, _blank_in_front)))
    give_back()
    return _last[0][2]


def _blank_in_front(texts: pa.Array) -> pa.Array:
    texts = texts.fill_null("")
    return pa.compute.if_else(pa.compute.equal(texts, ""), texts, pa.compute.binary_join_element_wise(" ", texts, ""))


def _encoded(v: Vocabulary, texts: pa.Array, change: Callable[[pa.Array], pa.Array] = lambda x: x) -> pa.Array:
    """Ids of texts, changed before, a few MB at a time."""
    return pa.concat_arrays([_lists([]), *(v.encode_all(change(texts[a:b])) for a, b in cuts(texts, AT_ONCE))])


KEY = "__id string, __x long, __y int"


def _key(docs: DataFrame) -> dict[str, Column]:
    """What tells giant rows apart; rows equal in id and text are solved once."""
    return {"__id": F.col("doc_id").cast("string"), "__x": F.xxhash64("text"), "__y": F.hash("text")}


def _giants(docs: DataFrame, held, token: str, chunk: int) -> DataFrame:
    """(key, __ids) of texts by the parallel scan over their chunks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = _worker(held, token).longest
        for b in batches:
            for row in range(b.num_rows):
                text = " " + b.column("text")[row].as_py()
                for no, i in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_pylist([{**{c: b.column(c)[row].as_py() for c in ("__id", "__x", "__y")}, "no": no, "body": text[i : i + chunk], "ahead": text[i + chunk : i + chunk + k - 1]}], schema)

    schema = pa.schema([("__id", pa.string()), ("__x", pa.int64()), ("__y", pa.int32()), ("no", pa.int32()), ("body", pa.string()), ("ahead", pa.string())])

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _worker(held, token)
        for b in batches:
            matrices = [v.transfer(x, y).tobytes() for x, y in zip(b.column("body").to_pylist(), b.column("ahead").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("__id", "__x", "__y", "no")), pa.array(matrices, pa.binary())], ["__id", "__x", "__y", "no", "matrix"])

    def reached(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("no")
        matrices = [np.frombuffer(m) for m in rows["matrix"].to_pylist()]
        n = int(np.sqrt(len(matrices[0])))
        found = rests(np.stack(matrices).reshape(-1, n, n))
        return rows.drop_columns("matrix").append_column("rest", pa.array([r.tobytes() for r in found], pa.binary()))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _worker(held, token)
        for b in batches:
            parts = zip(*(b.column(c).to_pylist() for c in ("body", "ahead", "rest")), strict=True)
            maps = [v.leads(x, y, np.frombuffer(r)).astype(np.int32).tobytes() for x, y, r in parts]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("__id", "__x", "__y", "no")), pa.array(maps, pa.binary())], ["__id", "__x", "__y", "no", "map"])

    def through(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("no")
        found = states(np.stack([np.frombuffer(m, np.int32) for m in rows["map"].to_pylist()]))
        rows = rows.drop_columns("map")
        return rows.append_column("left", pa.array([a for a, _ in found], pa.int32())).append_column("right", pa.array([b for _, b in found], pa.int32()))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _worker(held, token)
        for b in sliced(batches, "body", AT_ONCE):
            parts = zip(*(b.column(c).to_pylist() for c in ("body", "ahead", "left", "right")), strict=True)
            texts = pa.array([(body + ahead[:right])[left:] for body, ahead, left, right in parts], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("__id", "__x", "__y", "no")), _encoded(v, texts)], ["__id", "__x", "__y", "no", "ids"])

    by = ["__id", "__x", "__y"]
    rows = docs.select(*(c.alias(n) for n, c in _key(docs).items()), "text")
    chunks = cut(rows.mapInArrow(split, f"{KEY}, no int, body string, ahead string").dropDuplicates([*by, "no"]))
    def met(ways: DataFrame) -> DataFrame:
        ways = ways.withColumnsRenamed({c: f"w{c}" for c in [*by, "no"]})
        same = chunks["__id"].eqNullSafe(ways["w__id"]) & (chunks["__x"] == ways["w__x"]) & (chunks["__y"] == ways["w__y"]) & (chunks["no"] == ways["wno"])
        return chunks.join(ways, same)

    # a matrix and a map for each chunk of one document meet in one task: a few hundredths of that document's text
    # they are small, so their number of tasks is given: left to Spark, all documents' would go to one
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ways = grouped(chunks.mapInArrow(transfers, f"{KEY}, no int, matrix binary"), by, reached, f"{KEY}, no int, rest binary", parts)
    ways = met(ways).select(*by, "no", "body", "ahead", "rest").mapInArrow(lead, f"{KEY}, no int, map binary")
    ways = grouped(ways, by, through, f"{KEY}, no int, left int, right int", parts)
    traced = met(ways).select(*by, "no", "body", "ahead", "left", "right").mapInArrow(trace, f"{KEY}, no int, ids array<int>")
    whole = traced.groupBy(*by).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))
    return whole.select(F.col("__id").alias("__i"), F.col("__x").alias("__u"), F.col("__y").alias("__v"), F.col("ids").alias("__ids"))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))


@aside
def encode(docs: DataFrame, path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """Adds ids array<int>, the best cutting of each text into pieces, to documents (doc_id, text, ...).

    The sum of the pieces' scores is the most there is; ties go to the longer first
    piece, whether a text is split into chunks or not.  A blank is put in front of a
    text; a blank sign (U+2581) in a text and characters without a piece
    are spelled in bytes, so decode() gives back every text exactly.  Null and empty
    texts have no ids (an empty list).  All rows stay; equal texts get equal ids;
    input columns with an output's name give way; an empty table stays empty.
    """
    spark = docs.sparkSession
    vocabulary = load(path)
    vocabulary.trie  # noqa: B018  made once, here
    held, token = spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex  # a vocabulary of fixed size

    @F.arrow_udf("array<int>")
    def encoded(text: pa.Array) -> pa.Array:
        return _once(held, token, text)

    size = F.coalesce(F.length("text"), F.lit(0))
    short = replace(docs.where(size < chunk), ids=encoded(F.col("text")))
    long = docs.where(size >= chunk)
    found = _giants(long, held, token, chunk)
    keyed = long.withColumns(_key(long))
    far = keyed.join(found, keyed["__id"].eqNullSafe(found["__i"]) & (keyed["__x"] == found["__u"]) & (keyed["__y"] == found["__v"]))
    return short.unionByName(replace(far, ids=F.col("__ids")).select(*(f"`{c}`" for c in short.columns)))


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """Adds decoded string, the text of ids array<int>; no ids, or null, give empty text."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(Speller.of(load(path)))

    @F.arrow_udf("string")
    def spelled(ids: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.string()), *(held.value.decode(ids[a:b]) for a, b in cuts(ids))])

    return replace(rows, decoded=spelled(F.col("ids")))

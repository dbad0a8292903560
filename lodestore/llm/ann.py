"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Equal vectors are one node, with the few ids that can be among anyone's nearest.
Nodes are dealt to shards of bounded size.  In each shard a graph is grown: a greedy
beam search proposes neighbours for each new node, and relaxed distance pruning
keeps those that no kept neighbour is much nearer to, so edges stay diverse.  A
query walks the graph of every shard with a beam and the shards' best are merged by
exact score.

Graphs don't move to the queries: a shard's graph and then all queries stream through
one task, block by block.

Largest inner product becomes smallest distance by one more coordinate, which
gives all vectors of a shard the length of its longest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import matrix, usable

NEAREST = 20
SHARD_ROWS = 16_384
LEAST_SHARDS = 8
DEGREE, BEAM, RELAX = 32, 96, 1.2
SEARCH_BEAM = 128
STEP = 4  # beam entries opened at once
BLOCK = 256  # queries or new vectors that walk together
SLACK = 2  # times its degree that a node may have neighbours while the graph grows


def walk(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam's ids (-1: none) and squared distances, nearest first, for each query."""
    b, n, k = len(queries), len(x), max(beam, len(starts))
    lengths, own = (x * x).sum(1), (queries * queries).sum(1)
    seen = np.zeros((b, n), bool)
    ids = np.full((b, k), -1, np.int64)
    far = np.full((b, k), np.inf)
    opened = np.ones((b, k), bool)
    ids[:, : len(starts)] = starts
    far[:, : len(starts)] = lengths[starts] + own[:, None] - 2 * queries @ x[starts].T
    opened[:, : len(starts)] = False
    seen[:, starts] = True
    order = np.argsort(far, axis=1, kind="stable")
    ids, far, opened = (np.take_along_axis(a, order, 1) for a in (ids, far, opened))
    live = np.arange(b)
    while len(live):
        todo = ~opened[live]
        todo &= np.cumsum(todo, axis=1) <= STEP
        row, col = np.nonzero(todo)
        if not len(row):
            break
        opened[live[row], col] = True
        nodes = graph[ids[live[row], col]]
        query = np.repeat(live[row], nodes.shape[1])
        nodes = nodes.ravel()
        new = nodes >= 0
        query, nodes = query[new], nodes[new]
        new = ~seen[query, nodes]
        pair = np.unique(query[new] * n + nodes[new])
        query, nodes = pair // n, pair % n
        seen[query, nodes] = True
        d = lengths[nodes] + own[query] - 2 * np.einsum("ij,ij->i", x[nodes], queries[query])
        count = np.bincount(query, minlength=b)
        width = int(count.max(initial=0))
        if width:
            slot = np.arange(len(query)) - (np.cumsum(count) - count)[query]
            more_ids, more_far = np.full((b, width), -1, np.int64), np.full((b, width), np.inf)
            more_ids[query, slot], more_far[query, slot] = nodes, d
            hit = live[count[live] > 0]
            all_ids = np.concatenate([ids[hit], more_ids[hit]], 1)
            all_far = np.concatenate([far[hit], more_far[hit]], 1)
            all_open = np.concatenate([opened[hit], more_ids[hit] < 0], 1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :k]
            ids[hit], far[hit], opened[hit] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_far, all_open))
        live = live[(~opened[live]).any(1)]
    return ids, np.maximum(far, 0)


def prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most `degree` neighbours of each node among its candidates (-1: none), spread by relaxed distance."""
    out = np.full((len(nodes), degree), -1, np.int64)
    v = x[np.maximum(candidates, 0)]
    lengths = np.einsum("ijk,ijk->ij", v, v)
    among = lengths[:, :, None] + lengths[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    d = ((v - x[nodes][:, None]) ** 2).sum(2)
    d[(candidates < 0) | (candidates == nodes[:, None])] = np.inf
    rows = np.arange(len(nodes))
    for k in range(degree):
        pick = d.argmin(1)
        ok = np.isfinite(d[rows, pick])
        if not ok.any():
            break
        out[ok, k] = candidates[rows, pick][ok]
        d[ok[:, None] & (relax * relax * among[rows, pick] <= d)] = np.inf
        d[rows[ok], pick[ok]] = np.inf
    return out


def grow(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The graph (a row of neighbours for each vector, -1: none) and the nodes where searches start."""
    n, wide = len(x), SLACK * degree
    graph, size = np.full((n, wide), -1, np.int64), np.zeros(n, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    middle = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.concatenate([[middle], order[order != middle]])
    first = order[: degree + 1]
    for v in first:
        others = first[first != v]
        graph[v, : len(others)], size[v] = others, len(others)
    done = len(first)
    starts = np.array([middle])

    def pruned(nodes: np.ndarray, candidates: np.ndarray) -> None:
        for i in range(0, len(nodes), BLOCK):
            some = nodes[i : i + BLOCK]
            kept = prune(x, some, candidates[i : i + BLOCK], degree, relax)
            graph[some, :degree], graph[some, degree:] = kept, -1
            size[some] = (kept >= 0).sum(1)

    while done < n:
        new = order[done : done + min(BLOCK, max(16, done // 8))]
        near = walk(x, graph, starts, x[new], beam)[0]
        pruned(new, near)
        back, to = np.repeat(new, degree), graph[new, :degree].ravel()
        back, to = back[to >= 0], to[to >= 0]
        by = np.argsort(to, kind="stable")
        back, to = back[by], to[by]
        nodes, where, count = np.unique(to, return_index=True, return_counts=True)
        slot = np.arange(len(to)) - np.repeat(where, count)
        fits = size[nodes] + count <= wide
        put = np.repeat(fits, count)
        graph[to[put], size[to[put]] + slot[put]] = back[put]
        size[nodes[fits]] += count[fits]
        if not fits.all():
            full = nodes[~fits]
            more = np.full((len(full), int(count[~fits].max())), -1, np.int64)
            more[np.repeat(np.arange(len(full)), count[~fits]), slot[~put]] = back[~put]
            pruned(full, np.concatenate([graph[full], more], 1))
        done += len(new)
    over = np.flatnonzero(size > degree)
    pruned(over, graph[over])
    return graph[:, :degree], _reachable_starts(graph[:, :degree], middle)


def _reachable_starts(graph: np.ndarray, start: int) -> np.ndarray:
    """Start nodes from which every node can be reached."""
    seen = np.zeros(len(graph), bool)
    starts = []
    node = start
    while True:
        starts.append(node)
        front = np.array([node])
        seen[node] = True
        while len(front):
            front = np.unique(graph[front])
            front = front[front >= 0]
            front = front[~seen[front]]
            seen[front] = True
        if seen.all():
            return np.array(starts)
        node = int(np.argmin(seen))


def lifted(v: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate, so that all are as long as the longest."""
    size = (v * v).sum(1)
    return np.column_stack([v, np.sqrt(np.maximum(size.max(initial=0) - size, 0))])


def shards_for(rows: int) -> int:
    return max(LEAST_SHARDS, -(-rows // SHARD_ROWS))


NODES = "dim int, shard int, counts binary, ids binary, vectors binary, graph binary, starts binary"


def index(rows: DataFrame, k: int = NEAREST) -> DataFrame:
    """(dim, shard, counts, ids, vectors, graph, starts), a row for each shard of rows (vec_id long, v array<double>).

    A node is what rows have equal vectors; ids: its smallest k + 1, one after
    another, a repeated one as often as it occurs but no more than that.
    """
    keys = ("dim", "h", "g")
    each = rows.groupBy(F.size("v").alias("dim"), F.xxhash64("v").alias("h"), F.hash("v").alias("g"), "vec_id").agg(F.count("*").alias("m"), F.first("v").alias("v"))
    # only so many rows of a node leave a task
    few = each.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("n") <= k + 1)
    repeated = F.array_repeat("vec_id", F.least("m", F.lit(k + 1)).cast("int"))
    nodes = cut(few.groupBy(*keys).agg(F.first("v").alias("v"), F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", repeated.alias("ids")))), lambda x: x["ids"])), 1, 2 * k + 2).alias("ids")))
    shards = shards_for(nodes.count())
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("h", "g"), F.lit(shards)).cast("int")).select("dim", "shard", "h", "g", "ids", "v")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "g"], kind="stable")
        v = matrix(part["v"])
        graph, starts = grow(lifted(v).astype(np.float32))
        ids = part["ids"].to_numpy()
        packed = {"counts": np.array(list(map(len, ids)), np.int32), "ids": np.concatenate(ids).astype(np.int64), "vectors": v, "graph": graph.astype(np.int32), "starts": starts.astype(np.int32)}
        return pd.DataFrame({"dim": [v.shape[1]], "shard": [part["shard"].iloc[0]], **{n: [a.tobytes()] for n, a in packed.items()}})

    return cut(dealt.groupBy("dim", "shard").applyInPandas(build, NODES))


@dataclass
class Shard:
    """A shard's graph and what its nodes stand for."""

    v: np.ndarray
    x: np.ndarray
    graph: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Shard:
        counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        v = np.frombuffer(row["vectors"]).reshape(len(counts), -1)
        graph = np.frombuffer(row["graph"], np.int32).reshape(len(counts), -1).astype(np.int64)
        return cls(v, lifted(v).astype(np.float32), graph, np.frombuffer(row["starts"], np.int32).astype(np.int64), counts, np.cumsum(counts) - counts, np.frombuffer(row["ids"], np.int64))

    def best(self, names: np.ndarray, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best of each query here."""
        near = walk(self.x, self.graph, self.starts, np.column_stack([q, np.zeros(len(q))]).astype(np.float32), max(beam, k + 1))[0]
        row, col = np.nonzero(near >= 0)
        node = near[row, col]
        score = np.einsum("ij,ij->i", q[row], self.v[node])
        times = self.counts[node]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[node], times)
        row, score, ids = np.repeat(row, times), np.repeat(score, times), self.ids[place]
        other = ids != names[row]
        row, score, ids = row[other], score[other], ids[other]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        at = np.searchsorted(row, np.arange(len(q)))
        top = np.arange(len(row)) - at[row] < k
        return names[row[top]], ids[top], score[top]


def search(graphs: DataFrame, queries: DataFrame, k: int = NEAREST, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (vec_id long, v array<double>) against an index, without the query's own id."""
    each = graphs.select(F.col("dim").alias("of"), F.col("shard").alias("at"))
    asked = queries.select("vec_id", "v", F.size("v").alias("dim")).join(each, F.col("dim") == F.col("of")).select("dim", F.col("at").alias("shard"), "vec_id", "v")
    names = NODES.replace(" int", "").replace(" binary", "").split(", ")
    held = graphs.select(*names, F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"))
    both = held.unionByName(asked, allowMissingColumns=True)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Shard | None = None
        for b in batches:
            new = b.column("graph").is_valid().to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(new), len(new)]
            if cuts[0]:
                yield from answers(now, b.slice(0, int(cuts[0])))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                now = Shard.of({n: b.column(n)[int(lo)].as_py() for n in names[2:]})
                yield from answers(now, b.slice(int(lo) + 1, int(hi - lo - 1)))

    def answers(now: Shard, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, b.num_rows, BLOCK):
            part = b.slice(i, BLOCK)
            q = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in now.best(part.column("vec_id").to_numpy(), q, k, beam)], ["query_id", "vec_id", "score"])

    # a shard's graph sorts before its queries, which have none
    dealt = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", F.col("graph").isNull())
    best = dealt.mapInArrow(found, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, asked: Column, k: int = NEAREST) -> DataFrame:
    """(query_id, rank from 1, vec_id, score double): of each row picked by `asked`, the k other rows (vec_id, embedding) of largest inner product.

    Nearest first, ties to smaller vec_id; fewer than k candidates: all of them.
    Vectors that are null, zero or hold null or non-finite components and rows
    without an id take no part; vectors of another length are no candidates.
    Repeated ids are candidates once each time, but no query's own; a query that
    is repeated with one vector is answered once for each different vector.  Other
    columns are not looked at; an empty table gives an empty result.
    """
    good = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    good = good.withColumn("__asked", asked).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "__asked")
    return search(index(good, k), good.where("__asked").select("vec_id", "v").distinct(), k)

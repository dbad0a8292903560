"""Top-k search: exact, on chosen clusters, by probes, by levels.

Vectors stay where they are.  Queries travel to them as one matrix, scored a tile of
queries and vectors at a time; each task keeps its best k of each query, and only those meet
in a shuffle by query.  Where queries probe clusters, a cluster's vectors meet its own
queries only, and only probed clusters are read.  Products of matrices only tell which pairs
may count, with a bound on what they round off; the scores of those are sums in the order of
components, in double precision, as metrics.score() has them.  So equal vectors have equal
scores, ties go to the smaller id, and vectors whose score is not finite are never found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import tables
from ..functions import metrics
from ..types import Metric

QUERY_BLOCK = 4_096  # queries that go to the vectors at once
QUERY_TILE, ROW_TILE = 256, 2_048  # queries and vectors that are scored at once
ALL = 0  # nprobe: every cluster


@dataclass
class Asked:
    """A block of queries: ids, vectors, and the clusters that each one probes."""

    ids: np.ndarray
    x: np.ndarray
    probes: dict[int, np.ndarray] | None = None  # for each cluster, which queries ask for it


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def rough_scores(x: np.ndarray, q: np.ndarray, metric: Metric) -> np.ndarray:
    """Scores of queries (rows) with vectors (columns) by one product of matrices, of L2 the negative square; see rounding()."""
    inner = q @ x.T
    if metric is Metric.IP:
        return inner
    if metric is Metric.COSINE:
        inner /= (_norms(q) + metrics.EPSILON)[:, None]
        inner /= (_norms(x) + metrics.EPSILON)[None]
        return inner
    inner *= 2
    inner -= (q * q).sum(1)[:, None]
    inner -= (x * x).sum(1)[None]
    return inner


def rounding(x: np.ndarray, q: np.ndarray, metric: Metric) -> np.ndarray:
    """For each query, how far rough_scores() may be from exact_scores(), at most; infinite where norms overflow."""
    share = 4 * (x.shape[1] + 8) * np.finfo(float).eps
    if metric is Metric.COSINE:
        out = np.where(np.isfinite(_norms(q)) & np.isfinite(_norms(x)).all(), share, np.inf)
    else:
        far, longest = _norms(q), _norms(x).max()
        out = share * (far * longest if metric is Metric.IP else (far + longest) ** 2)
    return np.nan_to_num(out, nan=np.inf, posinf=np.inf) + np.finfo(float).tiny


def exact_scores(x: np.ndarray, q: np.ndarray, metric: Metric) -> np.ndarray:
    """Scores of pairs (columns of x and q; rows are components), larger is better: sums in the order of components."""

    def total(values: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros(x.shape[1])
        for v in values:
            out += v
        return out

    if metric is Metric.L2:
        return -np.sqrt(total((a - b) ** 2 for a, b in zip(x, q, strict=True)))
    inner = total(a * b for a, b in zip(x, q, strict=True))
    if metric is Metric.IP:
        return inner
    return inner / ((np.sqrt(total(a * a for a in x)) + metrics.EPSILON) * (np.sqrt(total(b * b for b in q)) + metrics.EPSILON))


def numpy_distance(score: np.ndarray, metric: Metric) -> np.ndarray:
    """Smaller is better: 1 - cosine, negative inner product, squared Euclidean."""
    return score * score if metric is Metric.L2 else (1 - score if metric is Metric.COSINE else -score)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that have dim components, none null, and where they are."""
    column = column.cast(pa.list_(pa.float64()))
    size = pa.compute.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    flat = column.take(pa.array(at)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return x, at


def _blocks(queries: DataFrame) -> Iterator[list]:
    """Queries on the driver, a block of bounded size at a time."""
    block = queries.limit(QUERY_BLOCK + 1).collect()
    if len(block) <= QUERY_BLOCK:  # without a job for each partition
        if block:
            yield block
        return
    block = []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            yield block
            block = []
    if block:
        yield block


def _codes(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of ids."""
    return ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]


class Best:
    """The best k of each of n queries so far: flat arrays of query, score and id, and of vectors if they are carried."""

    def __init__(self, n: int, k: int, ids: np.ndarray, dim: int = 0) -> None:
        self.k, self.query, self.score, self.id, self.x = k, np.zeros(0, np.int64), np.zeros(0), ids[:0], np.zeros((0, dim))
        self.worst = np.full(n, -np.inf)  # the k-th score of queries that have k

    def offer(self, queries: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, metric: Metric) -> None:
        """Vectors x, named ids, for queries: numbers, and their vectors q."""
        with np.errstate(all="ignore"):
            rough, off, worst = rough_scores(x, q, metric), rounding(x, q, metric), self.worst[queries]
            low = (-worst * worst * (1 + 8 * np.finfo(float).eps) if metric is Metric.L2 else worst) - off
            near = ~(rough < low[:, None])  # those that overflow too
            many = np.flatnonzero(near.sum(1) > 4 * self.k)
            if len(many):
                some = np.where(np.isfinite(rough[many]), rough[many], -np.inf)
                low[many] = np.maximum(low[many], np.partition(some, -self.k, axis=1)[:, -self.k] - 2 * off[many])
                near[many] = ~(rough[many] < low[many, None])
            row, col = np.nonzero(near)
            if not len(row):
                return
            score = self._scores(x, q, row, col, metric)
            fine = np.flatnonzero(np.isfinite(score) & (score >= worst[row]))  # ties with the k-th stay
        if len(fine):
            self._take(queries[row[fine]], score[fine], ids[col[fine]], x[col[fine]] if self.x.shape[1] else np.zeros((len(fine), 0)))

    @staticmethod
    def _scores(x: np.ndarray, q: np.ndarray, row: np.ndarray, col: np.ndarray, metric: Metric) -> np.ndarray:
        """Exact scores of some pairs, a bounded number of them at a time."""
        parts = []
        for i in range(0, len(row), 2_048):
            parts.append(exact_scores(x[col[i : i + 2_048]].T, q[row[i : i + 2_048]].T, metric))
        return np.concatenate(parts)

    def _take(self, query: np.ndarray, score: np.ndarray, name: np.ndarray, x: np.ndarray) -> None:
        touched = np.zeros(len(self.worst), bool)
        touched[query] = True
        old = touched[self.query]
        query, score, name, x = (np.concatenate([a[old], b]) for a, b in ((self.query, query), (self.score, score), (self.id, name), (self.x, x)))
        order = np.lexsort((_codes(name), -score, query))
        query, score = query[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        top = place < self.k
        kept = order[top]
        self.query, self.score = np.concatenate([self.query[~old], query[top]]), np.concatenate([self.score[~old], score[top]])
        self.id, self.x = np.concatenate([self.id[~old], name[kept]]), np.concatenate([self.x[~old], x[kept]])
        last = place == self.k - 1
        self.worst[query[last]] = score[last]


def _tiles(queries: np.ndarray, rows: np.ndarray, size: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Queries (numbers, ascending) and rows, as tiles of bounded size: number of the queries' tile, queries, rows."""
    for some in np.split(queries, np.flatnonzero(np.diff(queries // size[0])) + 1):
        for i in range(0, len(rows), size[1]):
            yield int(some[0]) // size[0], some, rows[i : i + size[1]]


def _scan(vectors: DataFrame, asked: Asked, k: int, metric: Metric, cluster: str | None, carry: bool = False) -> DataFrame:
    """The best k of each query in each task: (query_id, id, score), or (query_id, id, vector, q) if vectors are carried."""
    from pyspark.sql.pandas.types import to_arrow_schema

    held = vectors.sparkSession.sparkContext.broadcast(asked)  # QUERY_BLOCK vectors at most
    out = _found_type(vectors, isinstance(_kind(asked.ids), T.StringType), carry)
    schema, size = to_arrow_schema(out), (QUERY_TILE, ROW_TILE)

    def names(column: pa.Array) -> np.ndarray:
        return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist(), object)

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = held.value
        tops: dict[int, Best] = {}
        every = np.flatnonzero(np.isfinite(a.x).all(1))
        for b in batches:
            x, at = _matrix(b.column("vector"), a.x.shape[1])
            fine = np.isfinite(x).all(1)
            x, at = x[fine], at[fine]
            if not len(at) or not len(every):
                continue
            ids = names(b.column("id").take(pa.array(at)))
            if cluster is None:
                groups = [(every, np.arange(len(ids)))]
            else:
                place = b.column(cluster).take(pa.array(at)).fill_null(-1).to_numpy(zero_copy_only=False)
                order = np.argsort(place, kind="stable")
                cuts = np.flatnonzero(np.diff(place[order], prepend=place[order[0]] - 1))
                groups = [(np.intersect1d(a.probes[c], every), rows) for rows in np.split(order, cuts[1:]) if (c := int(place[rows[0]])) in a.probes]
            for queries, rows in groups:
                for tile, some, part in _tiles(queries, rows, size) if len(queries) else ():
                    if tile not in tops:
                        tops[tile] = Best(min(size[0], len(a.ids) - tile * size[0]), k, ids, a.x.shape[1] if carry else 0)
                    tops[tile].offer(some - tile * size[0], a.x[some], x[part], ids[part], metric)
        for tile, top in tops.items():
            at = top.query + tile * size[0]
            left = [pa.array(a.ids[at], schema.field(0).type), pa.array(top.id, schema.field(1).type)]
            yield pa.RecordBatch.from_arrays([*left, *([lists(top.x), lists(a.x[at])] if carry else [pa.array(top.score)])], schema.names)

    return vectors.select("id", "vector", *([cluster] if cluster else [])).mapInArrow(best, out)


def _kind(ids: np.ndarray) -> T.DataType:
    return T.StringType() if ids.dtype == object else T.LongType()


def _found_type(vectors: DataFrame, text: bool, carry: bool) -> T.StructType:
    found = [("vector", T.ArrayType(T.DoubleType())), ("q", T.ArrayType(T.DoubleType()))] if carry else [("score", T.DoubleType())]
    return T.StructType([T.StructField(n, t) for n, t in (("query_id", T.StringType() if text else T.LongType()), ("id", vectors.schema["id"].dataType), *found)])


def rank(found: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """Numbers (query_id, id, score) from 1 within each query, best first, and keeps k."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _found(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric, probes: DataFrame | None = None, cluster: str = "cluster_id", carry: bool = False) -> DataFrame:
    """What _scan() finds for all queries, a block of them at a time."""
    text = isinstance(queries.schema["query_id"].dataType, T.StringType)
    found = tables.local(vectors.sparkSession, [], _found_type(vectors, text, carry))
    asked = queries.select("query_id", "vector").where("vector is not null")
    if probes is not None:
        asked = asked.join(probes.groupBy("query_id").agg(F.collect_set(cluster).alias("clusters")), "query_id")
    if k > 0:
        for block in _blocks(asked):
            by_dim: dict[int, list] = {}
            for row in block:
                if None not in row["vector"]:
                    by_dim.setdefault(len(row["vector"]), []).append(row)
            for rows in by_dim.values():
                some = Asked(np.array([r["query_id"] for r in rows], object if text else np.int64), np.array([r["vector"] for r in rows], float))
                source = vectors
                if probes is not None:
                    pairs: dict[int, list[int]] = {}
                    for i, r in enumerate(rows):
                        for c in r["clusters"]:
                            pairs.setdefault(c, []).append(i)
                    some.probes = {c: np.array(i) for c, i in pairs.items()}
                    source = tables.in_parts(vectors, cluster, sorted(pairs))
                found = found.unionAll(_scan(source, some, k, metric, cluster if probes is not None else None, carry))
    return found


def search(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.COSINE, probes: DataFrame | None = None, cluster: str = "cluster_id") -> DataFrame:
    """(query_id, rank, id, score, distance): the k best vectors (id, vector) of each query (query_id, vector).

    probes: (query_id, cluster_id) limits a query to vectors of its clusters; of a
    table that tables.cut_parts() wrote, only those clusters' files are read.  k of 0
    or less finds nothing; k above the number of vectors finds all.
    """
    metric = Metric.parse(metric)
    out = rank(_found(vectors, queries, k, metric, probes, cluster), k)
    sides = {Metric.L2: F.col("score") * F.col("score"), Metric.COSINE: 1 - F.col("score"), Metric.IP: -F.col("score")}
    return out.select("query_id", "rank", "id", "score", sides[metric].alias("distance"))


def nearest_pairs(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.COSINE) -> DataFrame:
    """(query_id, id, vector, q): the k best vectors of each query in each task, beside the query's own, for expressions to score.

    They hold the k best of all, ties to the smaller id.
    """
    return _found(vectors, queries, k, Metric.parse(metric), carry=True)


def search_expr(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.COSINE) -> DataFrame:
    """search() with scores that are column expressions, of the pairs that may be among a query's k best."""
    pairs = nearest_pairs(vectors, queries, k, metric)
    scored = pairs.select("query_id", "id", metrics.score(F.col("vector"), F.col("q"), metric).alias("score"))
    return rank(scored, k).select("query_id", "rank", "id", "score")


def assign(vectors: DataFrame, centroids: DataFrame, metric: Metric | str = Metric.L2, normalized: bool = False) -> DataFrame:
    """Adds cluster_id int, the nearest of the centroids (cluster_id, centroid); ties to the smallest id; null without centroids.

    The centroids are the index's routing table and go to every task; an index has
    as many as its creator gives it.
    """
    metric = Metric.parse(metric)
    rows = centroids.orderBy("cluster_id").collect()
    names = np.array([r["cluster_id"] for r in rows], np.int32)
    held = vectors.sparkSession.sparkContext.broadcast((names, np.array([r["centroid"] for r in rows], float).reshape(len(rows), -1)))

    @F.arrow_udf("int")
    def nearest(vector: pa.Array) -> pa.Array:
        ids, c = held.value
        out = np.full(len(vector), -1, np.int64)
        if len(ids):
            x, at = _matrix(vector, c.shape[1])
            inner = x @ c.T
            if metric is Metric.COSINE and not normalized:
                size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None]
                far = np.where(size > 0, 1 - inner / np.maximum(size, 1e-300), 1.0)
            elif metric is Metric.L2:
                far = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * inner
            else:
                far = -inner
            out[at] = ids[far.argmin(1)]
        return pa.array([None if i < 0 else int(i) for i in out], pa.int32())

    return vectors.drop("cluster_id").withColumn("cluster_id", nearest(F.col("vector")))


def probe(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: Metric | str = Metric.L2, normalized: bool = False) -> DataFrame:
    """(query_id, cluster_id): the nprobe nearest centroids of each query; 0 or less: all."""
    table = centroids.select("cluster_id", "centroid")
    pairs = queries.select("query_id", "vector").join(F.broadcast(table))  # the routing table, see assign()
    if nprobe <= ALL:
        return pairs.select("query_id", "cluster_id")
    far = pairs.select("query_id", "cluster_id", metrics.distance(F.col("vector"), F.col("centroid"), metric, normalized).alias("far"))
    order = Window.partitionBy("query_id").orderBy("far", "cluster_id")
    return far.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= nprobe).select("query_id", "cluster_id")


def search_probes(vectors: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int = 32, metric: Metric | str = Metric.L2, normalized: bool = False) -> DataFrame:
    """search() of placed vectors (id, vector, cluster_id) in each query's nprobe nearest clusters."""
    return search(vectors, queries, k, metric, probe(queries, centroids, nprobe, metric, normalized))


def search_on(vectors: DataFrame, queries: DataFrame, clusters: list[int], k: int, metric: Metric | str = Metric.L2) -> DataFrame:
    """search() in given clusters alone."""
    return search(tables.in_parts(vectors, "cluster_id", [int(c) for c in clusters]), queries, k, metric)


def merge(levels: list[DataFrame], k: int) -> DataFrame:
    """The k best of each query over several results (query_id, id, score), without removing repeats."""
    out = levels[0].select("query_id", "id", "score")
    for level in levels[1:]:
        out = out.unionAll(level.select("query_id", "id", "score"))
    return rank(out, k).select("query_id", "rank", "id", "score")


def kth_distance(hits: DataFrame) -> DataFrame:
    """(query_id, kth): the largest distance of each query's hits (query_id, distance)."""
    return hits.groupBy("query_id").agg(F.max("distance").alias("kth"))


def search_levels(fresh: DataFrame, settled: DataFrame, queries: DataFrame, k: int, threshold: float, metric: Metric | str = Metric.L2, centroids: DataFrame | None = None, nprobe: int = ALL) -> DataFrame:
    """Searches the fresh level; queries whose k-th hit there is farther than threshold, or without hits, search the settled one too.

    Only the queries that need the settled level travel to it, with a routing table of
    its own to their nprobe nearest clusters there.
    """
    near = search(fresh, queries, k, metric)
    kth = kth_distance(near)
    short = queries.join(kth, "query_id", "left").where(F.coalesce(F.col("kth") > threshold, F.lit(True))).select(*queries.columns)
    far = search(settled, short, k, metric) if centroids is None else search_probes(settled, centroids, short, k, nprobe, metric)
    return merge([near, far], k)


def delete_nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.COSINE) -> tuple[DataFrame, DataFrame]:
    """Vectors (id, vector, ...) without the k nearest of any query, and the distinct ids that went."""
    gone = search(vectors, queries, k, metric).select("id").distinct()
    return vectors.join(gone, "id", "left_anti"), gone


def hydrate(hits: DataFrame, docs: DataFrame, metadata: bool = True) -> DataFrame:
    """Hits with the data, and metadata, of the document whose doc_id is their id; null where there is none."""
    kept = docs.select(F.col("doc_id").alias("id"), "data", *(["metadata"] if metadata else []))
    return hits.join(kept, "id", "left")


def with_payload(hits: DataFrame, key: str = "_data") -> DataFrame:
    """Hits whose metadata also holds their payload."""
    return hits.withColumn("metadata", F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit(key), F.col("payload"))))


def nest(hits: DataFrame) -> DataFrame:
    """(query_id, hits array<struct<rank, id, score>>): one row for each query."""
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("hits"))


def smallest(rows: DataFrame, by: str, k: int, value: Column, tie: Column) -> DataFrame:
    """The k rows of each group with the smallest values; k of 0 or less: none."""
    order = Window.partitionBy(by).orderBy(value, tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

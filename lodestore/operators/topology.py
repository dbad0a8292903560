"""Index topology: centroids, placed vectors, levels, training and compaction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..functions import metrics
from ..types import CENTROIDS, Metric
from .search import assign

ROWS_PER_CLUSTER = 256
TRAIN_ROWS = 1_000_000  # vectors that centroids are trained on, about
COMPACT_RATIO = 0.7
SPLIT_ROWS = 200_000


def zero_centroids(spark, nlist: int, dim: int) -> DataFrame:
    """So many zero centroids, numbered from 0."""
    return spark.range(nlist).select(F.col("id").cast("int").alias("cluster_id"), metrics.zeros(dim).alias("centroid"))


def set_centroids(new: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new routing table, and placed vectors without those of clusters beyond it; others stay where they are."""
    return new, placed.join(F.broadcast(new.select("cluster_id")), "cluster_id", "left_semi")


def add_cluster(centroids: DataFrame, centroid: list[float]) -> tuple[DataFrame, int]:
    """The routing table with one more centroid, and its id, the number of clusters before."""
    n = nlist(centroids)
    return centroids.unionByName(centroids.sparkSession.createDataFrame([(n, [float(x) for x in centroid])], CENTROIDS)), n


def set_centroid(centroids: DataFrame, cluster_id: int, centroid: list[float]) -> DataFrame:
    """The routing table with one centroid changed; vectors aren't placed anew."""
    value = F.array(*(F.lit(float(x)).cast("float") for x in centroid))
    return centroids.withColumn("centroid", F.when(F.col("cluster_id") == cluster_id, value).otherwise(F.col("centroid")))


def nlist(centroids: DataFrame) -> int:
    return centroids.count()


def train(vectors: DataFrame, metric: Metric | str = Metric.L2, rows_per_cluster: int = ROWS_PER_CLUSTER, seed: int = 42) -> DataFrame:
    """Centroids of max(1, n // rows_per_cluster) clusters by k-means; cosine trains on normalised vectors.

    Training is Spark's own distributed k-means, on a sample of about TRAIN_ROWS.  The
    centroids are held by the driver and every task, so rows_per_cluster says how
    large a routing table may be.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    unit = metrics.normalize(F.col("vector")) if Metric.parse(metric) is Metric.COSINE else F.col("vector")
    rows = vectors.select(array_to_vector(unit.cast("array<double>")).alias("features"))
    rows = rows.sample(TRAIN_ROWS / n, seed) if n > TRAIN_ROWS else rows
    if n == 0:
        return vectors.sparkSession.createDataFrame([], CENTROIDS)
    model = KMeans(k=max(1, n // rows_per_cluster), seed=seed, maxIter=10).fit(rows)
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], CENTROIDS)


def place(vectors: DataFrame, centroids: DataFrame, metric: Metric | str = Metric.L2, level: int = 2) -> DataFrame:
    """Vectors with the cluster of their nearest centroid, and their level."""
    return assign(vectors, centroids, metric).withColumn("level", F.lit(level))


def cluster_sizes(placed: DataFrame) -> DataFrame:
    """(cluster_id, live): vectors in each cluster."""
    return placed.groupBy("cluster_id").agg(F.count("*").alias("live"))


def moved_centroids(centroids: DataFrame, live: DataFrame, added: DataFrame) -> DataFrame:
    """Centroids weighted by their live vectors, moved by the vectors added: (live * old + sum) / (live + n)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for b in batches:
            homes = b.column("cluster_id").to_numpy(zero_copy_only=False)
            size = pa.compute.list_value_length(b.column("vector")).fill_null(0).to_numpy(zero_copy_only=False)
            for c in np.unique(homes):
                mine = np.flatnonzero((homes == c) & (size > 0))
                if len(mine):
                    x = b.column("vector").take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(mine), -1)
                    total[c] = total.get(c, 0.0) + x.sum(0)
                    count[c] = count.get(c, 0) + len(mine)
        if total:
            lists = pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([int(c) for c in total], pa.int32()), lists, pa.array(list(count.values()), pa.int64())], ["cluster_id", "s", "n"])

    # each task sends one row for a cluster
    parts = added.where("cluster_id is not null").select(F.col("cluster_id").cast("int"), "vector").mapInArrow(sums, "cluster_id int, s array<double>, n long")
    each = parts.select("cluster_id", "n", F.posexplode("s").alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    sums_ = each.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("s"), F.first("n").alias("n"))
    old = centroids.join(live, "cluster_id", "left").select("cluster_id", "centroid", F.coalesce("live", F.lit(0)).alias("live")).join(sums_, "cluster_id", "left")
    moved = F.zip_with("centroid", "s", lambda c, s: ((F.col("live") * c.cast("double") + s["x"]) / (F.col("live") + F.col("n"))).cast("float"))
    return old.select("cluster_id", F.when(F.col("n").isNull(), F.col("centroid").cast("array<float>")).otherwise(moved).alias("centroid"))


def _far(x: np.ndarray, c: np.ndarray, metric: Metric, normalized: bool) -> np.ndarray:
    """Distances of vectors (rows) from centroids (columns)."""
    if metric is Metric.L2:
        return (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T
    inner = x @ c.T
    if metric is Metric.IP:
        return -inner
    if normalized:
        return 1 - inner
    size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None]
    return np.where(size > 0, 1 - inner / np.maximum(size, 1e-300), 1.0)


def grow(rows: DataFrame, centroids: DataFrame, live: DataFrame, order: str, metric: Metric | str, new_threshold: float, merge_threshold: float = float("inf"), cap: int = 1, normalized: bool = False, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """grow_online() of a batch of any size: rows (order, vector, ...) with cluster_id, new centroids, new (cluster_id, live).

    Only rows that open a cluster depend on those before them, and no more than `cap`
    do.  Each round finds the first row, in order, that opens one next to those there
    are; rounds are passes over the batch where it lies, and none of it comes to the
    driver but the vectors that become centroids.  Values of `order` are distinct.
    keep: writes the placed rows, once; without it each of the three results places
    them anew, with twice as many Python processes where rows are summed as well.
    """
    metric = Metric.parse(metric)
    names, table, opened = [], [], []
    for r in centroids.orderBy("cluster_id").collect():
        names.append(r["cluster_id"])
        table.append([float(x) for x in r["centroid"]])
        opened.append(None)

    def nearest(held: tuple[list, list, list]):
        @F.arrow_udf("struct<cluster_id:int,far:double>")
        def found(at: pa.Array, vector: pa.Array) -> pa.Array:
            ids, c, since = held
            home, far = np.full(len(at), -1, np.int64), np.full(len(at), np.inf)
            if ids and len(at):
                size = pa.compute.list_value_length(vector).fill_null(-1).to_numpy(zero_copy_only=False)
                fits = np.flatnonzero(size == len(c[0]))
                x = vector.take(pa.array(fits, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(fits), len(c[0]))
                d = _far(x, np.array(c, float), metric, normalized)
                places = at.take(pa.array(fits, pa.int64()))
                for k, first in enumerate(since):
                    if first is not None:  # seen by the row that opened it and those after it
                        early = pa.compute.less(places, pa.scalar(first, places.type)).to_numpy(zero_copy_only=False)
                        d[early, k] = np.inf
                at_ = d.argmin(1)
                low = d[np.arange(len(fits)), at_]
                home[fits], far[fits] = np.where(np.isfinite(low), np.array(ids)[at_], -1), low
            return pa.StructArray.from_arrays([pa.array(home, pa.int32()), pa.array(far)], ["cluster_id", "far"])

        return found(F.col(order), F.col("vector").cast("array<double>"))

    while len(table) < cap:
        near = rows.select(order, "vector", nearest((names, table, opened)).alias("__near"))
        opens = F.col("__near.far") > new_threshold
        if np.isfinite(merge_threshold):
            opens = opens & (F.col("__near.far") > merge_threshold)
        if opened and opened[-1] is not None:
            opens = opens & (F.col(order) > F.lit(opened[-1]))
        found = near.where(opens & F.col("vector").isNotNull()).agg(F.min_by(F.struct(order, "vector"), order).alias("row")).first()["row"]
        if found is None:
            break
        names.append(max(names, default=-1) + 1)
        table.append([float(x) for x in found["vector"]])
        opened.append(found[order])
    placed = rows.drop("cluster_id").withColumn("__near", nearest((names, table, opened))).withColumn("cluster_id", F.nullif(F.col("__near.cluster_id"), F.lit(-1))).drop("__near")
    placed = placed if keep is None else keep(placed)
    every = tables.local(rows.sparkSession, list(zip(names, table, strict=True)), CENTROIDS)
    new = cluster_sizes(placed.where("cluster_id is not null")).withColumnRenamed("live", "added")
    counts = every.select("cluster_id").join(live, "cluster_id", "left").join(new, "cluster_id", "left")
    counts = counts.select("cluster_id", (F.coalesce("live", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("live"))
    return placed, moved_centroids(every, live, placed), counts


def grow_online(centroids: list[np.ndarray], live: list[int], batch: np.ndarray, metric: Metric | str, new_threshold: float, merge_threshold: float = float("inf"), cap: int = 1, normalized: bool = False) -> tuple[list[int], list[np.ndarray], list[int]]:
    """Greedy online clustering of a micro-batch, in order: cluster of each row, new centroids, new live counts.

    A row joins its nearest cluster if that is within a finite merge_threshold; else it
    opens a cluster of its own, seen by the rows after it, if the nearest is farther
    than new_threshold or there is none, and the cap allows; else it joins the nearest.
    Touched centroids then move to the mean of their old and new vectors.
    """
    metric = Metric.parse(metric)
    table, counts = [np.asarray(c, float) for c in centroids], list(live)

    homes: list[int] = []
    for x in np.asarray(batch, float):
        best, at = np.inf, -1
        if table:
            d = _far(x[None], np.array(table), metric, normalized)[0]
            at = int(d.argmin())
            best = float(d[at])
        if at >= 0 and np.isfinite(merge_threshold) and best <= merge_threshold:
            pass
        elif (at < 0 or best > new_threshold) and len(table) < cap:
            table.append(x.copy())
            counts.append(0)
            at = len(table) - 1
        homes.append(at)
    moved = [c.copy() for c in table]
    for c in set(homes) - {-1}:
        mine = np.asarray(batch, float)[[i for i, h in enumerate(homes) if h == c]]
        moved[c] = (counts[c] * table[c] + mine.sum(0)) / (counts[c] + len(mine))
        counts[c] += len(mine)
    return homes, moved, counts


def needs_compaction(live: int, physical: int, ratio: float = COMPACT_RATIO) -> bool:
    """Whether so many rows of a cluster are deleted that it is worth writing anew."""
    return physical > 0 and live / physical < ratio


def compaction_plan(physical: DataFrame, tombstones: DataFrame, ratio: float = COMPACT_RATIO) -> DataFrame:
    """(cluster_id, physical, live) of the clusters to write anew."""
    kept = physical.join(tombstones.select("ext_id").withColumn("dead", F.lit(1)).distinct(), "ext_id", "left")
    sizes = kept.groupBy("cluster_id").agg(F.count("*").alias("physical"), F.count(F.when(F.col("dead").isNull(), 1)).alias("live"))
    return sizes.where(F.col("live") / F.col("physical") < ratio)


def split_large(placed: DataFrame, centroids: DataFrame, most: int = SPLIT_ROWS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """An extension: clusters above `most` rows are parted in two by k-means and their rows placed anew."""
    large = [r["cluster_id"] for r in cluster_sizes(placed).where(F.col("live") > most).collect()]
    table = centroids
    for c in large:
        mine = placed.where(F.col("cluster_id") == c)
        two = [r["centroid"] for r in train(mine, rows_per_cluster=max(1, mine.count() // 2), seed=seed).collect()]
        table = set_centroid(table, c, two[0])
        for extra in two[1:]:
            table, _ = add_cluster(table, extra)
    return (place(placed.drop("cluster_id", "level"), table), table) if large else (placed, table)

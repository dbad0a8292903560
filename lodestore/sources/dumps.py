"""Index dumps: a routing table and placed vectors, as Parquet in a version directory.

    <path>/meta        metric, dim, nlist: one row
    <path>/centroids   cluster_id, centroid
    <path>/vectors     partitioned by cluster_id

A flat dump has one cluster, 0, and a zero centroid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..types import CENTROIDS, Metric

# Metric codes of saved indexes.
METRIC_CODES = {0: Metric.IP, 1: Metric.L2, 2: Metric.COSINE}


def metric_of_code(code: int) -> Metric:
    """The metric that a saved index's numeric code stands for."""
    if code not in METRIC_CODES:
        raise ValueError(f"unsupported metric code: {code}")
    return METRIC_CODES[code]


@dataclass
class Dump:
    metric: Metric
    dim: int
    centroids: DataFrame
    vectors: DataFrame  # ext_id, vector, cluster_id


def write(path: str, vectors: DataFrame, centroids: DataFrame, metric: Metric | str, dim: int) -> None:
    """Writes placed vectors (ext_id, vector, ..., cluster_id), one partition of files for each cluster."""
    spark = vectors.sparkSession
    spark.createDataFrame([(Metric.parse(metric).value, dim, centroids.count())], "metric string, dim int, nlist int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    centroids.select("cluster_id", "centroid").write.mode("overwrite").parquet(f"{path}/centroids")
    # large clusters are dealt to several tasks
    dealt = vectors.repartition(F.col("cluster_id"), F.pmod(F.xxhash64("ext_id"), F.lit(8)))
    dealt.write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/vectors")


def write_flat(path: str, vectors: DataFrame, metric: Metric | str, dim: int) -> None:
    """Writes vectors without clusters; rows without ext_id are numbered from 0."""
    from ..operators.stats import numbered

    if "ext_id" not in vectors.columns:
        vectors = numbered(vectors.withColumn("__at", F.monotonically_increasing_id()), "__at").withColumn("ext_id", F.col("row").cast("string")).drop("row", "__at")
    zero = vectors.sparkSession.range(1).select(F.lit(0).alias("cluster_id"), metrics.zeros(dim).alias("centroid"))
    write(path, vectors.withColumn("cluster_id", F.lit(0)), zero, metric, dim)


def read(spark: SparkSession, path: str) -> Dump:
    """A dump's parts; vectors of a wrong length are an error when they are read."""
    meta = spark.read.parquet(f"{path}/meta").first()
    vectors = spark.read.parquet(f"{path}/vectors")
    vectors = vectors.withColumns({"vector": metrics.require_dim(F.col("vector"), meta["dim"]), "cluster_id": F.col("cluster_id").cast("int")})
    return Dump(Metric.parse(meta["metric"]), meta["dim"], spark.read.schema(CENTROIDS).parquet(f"{path}/centroids"), vectors)


def replace_cluster(path: str, cluster_id: int, vectors: DataFrame) -> None:
    """Replaces the contents of one cluster of a dump; the others' files stay."""
    vectors.withColumn("cluster_id", F.lit(cluster_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cluster_id").parquet(f"{path}/vectors")

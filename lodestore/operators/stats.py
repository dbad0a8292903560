"""Statistics of workloads and small relational helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINTS = (0.5, 0.95, 0.99)
CUTS = 2_000  # values that ranges are cut by, about


def latency_summary(rows: DataFrame, value: str = "seconds", by: str = "kind", scale: float = 1000.0) -> DataFrame:
    """Count, mean, p50, p95, p99 and maximum of a value for each kind; exact percentiles, interpolated.

    Different values are counted and ranked by ranges, so neither a kind nor a value
    that many rows have is ever gathered in one task.
    """
    each = rows.select(F.col(by).alias("__by"), (F.col(value) * scale).alias("__v"))
    sums = each.groupBy("__by").agg(F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.max("__v").alias("max"))
    counted = each.where("__v is not null").groupBy("__by", "__v").agg(F.count("*").alias("m"))
    counted = counted.withColumn("part", _ranges(counted, "__v"))
    base = counted.groupBy("__by", "part").agg(F.sum("m").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("__by").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = base.select(F.col("__by").alias("__k"), F.col("part").alias("__p"), F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("m").over(Window.partitionBy("__by", "part").orderBy("__v"))
    placed = counted.withColumn("inside", inside).join(base, F.col("__by").eqNullSafe(F.col("__k")) & (F.col("part") == F.col("__p")))
    # a value's rows have the places from lo to hi - 1
    placed = placed.withColumn("hi", F.col("base") + F.col("inside")).withColumn("lo", F.col("hi") - F.col("m"))
    placed = placed.join(sums.select(F.col("__by").alias("__n"), "n"), F.col("__by").eqNullSafe(F.col("__n")))
    wanted = []
    for p in POINTS:
        at = (F.col("n") - 1) * p
        for share, place in ((1 - (at - F.floor(at)), F.floor(at)), (at - F.floor(at), F.least(F.floor(at) + 1, F.col("n") - 1))):
            wanted.append(F.sum(F.when((F.col("lo") <= place) & (place < F.col("hi")), F.col("__v") * share)).alias(f"w{len(wanted)}"))
    found = placed.groupBy("__by").agg(*wanted)
    found = found.select(F.col("__by").alias("__f"), *((F.col(f"w{2 * i}") + F.col(f"w{2 * i + 1}")).alias(f"p{round(p * 100)}") for i, p in enumerate(POINTS)))
    out = sums.join(found, F.col("__by").eqNullSafe(F.col("__f")), "left")
    return out.select(F.col("__by").alias(by), "n", "mean", *(f"p{round(p * 100)}" for p in POINTS), "max")


def _ranges(rows: DataFrame, order: str) -> Column:
    """About equally full ranges of a column, numbered in its order; -1 for null.  They only spread work."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    seen = sorted(r[0] for r in rows.select(order).where(F.col(order).isNotNull()).sample(min(1.0, CUTS / max(1, n)), 1).limit(2 * CUTS).collect())
    cuts = sorted({seen[len(seen) * i // parts] for i in range(1, parts)} if seen else set())
    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))), F.lit(0)) if cuts else F.lit(0)
    return F.when(F.col(order).isNull(), -1).otherwise(part)


def throughput(rows: DataFrame) -> DataFrame:
    """(inserted, queries, seconds, ops_per_sec) of runs (inserted, queries, seconds)."""
    sums = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("inserted", "queries", "seconds")))
    return sums.withColumn("ops_per_sec", F.when(F.col("seconds") > 0, (F.col("inserted") + F.col("queries")) / F.col("seconds")))


def ordinal(by: Sequence[Column], order: Sequence[Column]) -> Column:
    """Place of a row in its group, from 0."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1


def chunked(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds chunk long: rows in order, `size` to a chunk.  The order is global, so ranges are counted first and rows numbered within them."""
    return numbered(rows, order).withColumn("chunk", F.floor(F.col("row") / size).cast("long")).drop("row")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Adds row long, from 0 in the order of a column, without gathering rows in one task."""
    rows = rows.withColumn("__part", _ranges(rows, order))  # wherever ranges are cut, numbers are exact
    base = rows.groupBy("__part").count()
    base = base.withColumn("__base", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return rows.join(F.broadcast(base), "__part").withColumn("row", (F.col("__base") + inside - 1).cast("long")).drop("__part", "__base")

"""Mixing sources to target weights.

Words are summed per source, each source gets a target, and a document is taken
floor(rate) times plus one more with the probability of the rate's fraction,
drawn by a hash of the document and a seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, aside, cut, replace

WEIGHTS = (1, 2, 3)
MOST = 3


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 (inclusive) to 1, the same on every run; rows without an id draw by their text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _ordered(df: DataFrame, by: Sequence[Column], *sums: tuple[str, str]) -> DataFrame:
    """Adds row (from 0) and running sums, in order, without gathering the rows.

    The rows are dealt by ranges and written; each range is summed on its own,
    and only one row for each range meets in one place.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    part = cut(part)
    along = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = part.groupBy("__part").agg(F.count("*").alias("row"), *(F.sum(c).alias(s) for c, s in sums))
    base = base.select("__part", *(F.coalesce(F.sum(s).over(along), F.lit(0)).alias(f"__{s}") for s in ("row", *(s for _, s in sums))))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    out = part.join(F.broadcast(base), "__part")  # a row for each range: at most spark.sql.shuffle.partitions
    return out.select(*df.columns, (F.col("__row") + F.row_number().over(Window.partitionBy("__part").orderBy("__at")) - 1).alias("row"), *((F.col(f"__{s}") + F.sum(c).over(inside)).alias(s) for c, s in sums))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds target double to (source, source_size long), one row for each source.

    Sources in order of code points, null last, weigh as weights says, repeating.
    The total of all sizes is shared by weight; a target stops at `most` times its
    source's size and the excess is shared again by weight among the others, until
    none is above.  That is the level at which all targets not stopped stand equal
    per weight: sources in order of most * size / weight stop first, so one pass
    of running sums finds it.
    """
    ranked = _ordered(sizes, [F.col("source").asc_nulls_last()])
    ranked = ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("row") % len(weights) + 1).cast("int")).cast("long").alias("weight"))
    ranked = ranked.withColumns({"limit": F.col("source_size") * most, "stop": F.col("source_size") * most / F.col("weight")})
    summed = _ordered(ranked, [F.col("stop"), F.col("source").asc_nulls_last()], ("limit", "sum_limit"), ("weight", "sum_weight"))
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("long").alias("total"), F.lit(1).alias("__one"))
    whole = ranked.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("all_weight"))
    both = summed.join(F.broadcast(total.crossJoin(whole)))  # one row
    # the level that holds if this source and all after it are not stopped; it rises up to the true one and falls after it
    level = (F.col("total") - (F.col("sum_limit") - F.col("limit"))).cast("double") / (F.col("all_weight") - (F.col("sum_weight") - F.col("weight"))).cast("double")
    top = both.agg(F.max(F.when(level <= F.col("stop"), level)).alias("level"))
    return both.join(F.broadcast(top)).select("source", "source_size", F.coalesce(F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")), F.col("limit").cast("double")).alias("target"))


def _planned(docs: DataFrame, weights: Sequence[int], most: int, seed: int) -> DataFrame:
    """Input columns plus __size, __source_size, __target, __rate and __copies."""
    sizes = cut(docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")))
    aims = targets(sizes, weights, most).select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    # a written row for each source, whose size Spark knows: it is broadcast while small, else hot sources are split
    aims = cut(aims)
    out = docs.withColumns({"__size": word_count(F.col("text")), "__draw": draw(F.col("doc_id"), F.col("text"), seed)}).join(aims, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("__source_size") > 0, F.least(F.col("__target") / F.col("__source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    out = out.withColumn("__rate", rate)
    extra = (F.col("__draw") < F.col("__rate") - F.floor("__rate")).cast("long")
    return out.withColumn("__copies", F.floor("__rate") + extra).drop("__draw")


@aside
def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """Adds size long, source_size long, target double, rate double and copies long to documents (doc_id, text, source, ...).

    Every row stays.  Null text has size 0; null is a source of its own; a source
    without words has target and rate 0 and no copies.  Repeated rows draw alike.
    Input columns with an output's name give way.  An empty table stays empty.
    """
    out = _planned(docs, weights, most, seed)
    names = ("size", "source_size", "target", "rate", "copies")
    return replace(out, **{c: F.col(f"__{c}") for c in names}).drop(*(f"__{c}" for c in names))


@aside
def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """The mixed table: every document as often as its plan says, with the columns of the input."""
    out = _planned(docs, weights, most, seed).where("__copies > 0")
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))

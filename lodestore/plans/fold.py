"""Folding an ordered operation log into a collection, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import Op

VALUES = ("vector", "metadata", "payload")


def fold(base: DataFrame, log: DataFrame, insert_if_absent: bool = False, values: tuple[str, ...] = VALUES) -> DataFrame:
    """The collection (ext_id, vector, metadata, payload) after all rows of the log (seq, pos, op, ext_id, vector, metadata, payload).

    Operations on an id act in order of seq and pos: an insert puts its values in
    place, an update does so if the id is there then (or insert_if_absent), a delete
    takes the row away.  What counts is the last operation, unless only updates
    follow the last delete or the id was never there.  `values` are the columns that
    come from the log.
    """
    at = F.struct("seq", "pos")
    dead = F.max(F.when(F.col("op") == Op.DELETE_IDS.value, at))
    born = F.max(F.when(F.col("op").isin(Op.INSERT.value, *([Op.UPDATE.value] if insert_if_absent else [])), at))
    by_id = log.groupBy("ext_id").agg(F.max_by(F.struct("op", *values), at).alias("last"), dead.alias("dead"), born.alias("born"))
    by_id = by_id.withColumns({"gone": F.col("dead").isNotNull(), "new": F.col("born").isNotNull() & (F.col("dead").isNull() | (F.col("born") > F.col("dead")))})
    both = base.withColumn("had", F.lit(True)).join(by_id.select("ext_id", "last", "gone", "new"), "ext_id", "full")
    had, touched = F.col("had").isNotNull(), F.col("last").isNotNull()
    use = touched & (F.col("last.op") != Op.DELETE_IDS.value) & (F.col("new") | (had & ~F.col("gone")))
    kept = had & (~touched | (~use & ~F.col("gone")))
    out = both.where(use | kept)
    extra = [c for c in base.columns if c not in ("ext_id", *values)]
    return out.select("ext_id", *(F.when(use, F.col(f"last.{c}")).otherwise(F.col(c)).alias(c) for c in values), *(F.when(~use, F.col(c)).alias(c) for c in extra))

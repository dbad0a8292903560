"""Keyed mutations of collections (ext_id, vector, metadata, payload) and document tables.

One id is one row.  A batch is folded first, its last occurrence of an id wins, and
then meets the collection in one join on the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import numbered


def _one(rows: DataFrame, key: str, pick, order: tuple[str, ...]) -> DataFrame:
    """A row of each key, by one aggregation, of which each task sends one row for a key at most."""
    kept = rows.groupBy(key).agg(pick(F.struct(*(f"`{c}`" for c in rows.columns if c != key)), F.struct(*order)).alias("__row"))
    return kept.select(*(F.col(key) if c == key else F.col(f"__row.`{c}`").alias(c) for c in rows.columns))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by the given columns; nulls come first."""
    return _one(rows, key, F.max_by, order)


def first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, by the given columns; nulls come first."""
    return _one(rows, key, F.min_by, order)


def upsert(rows: DataFrame, batch: DataFrame, key: str = "ext_id") -> DataFrame:
    """rows with the batch's rows in place of those of the same key; a batch's keys are distinct."""
    return rows.join(batch.select(key), key, "left_anti").unionByName(batch.select(*rows.columns))


def update(rows: DataFrame, batch: DataFrame, key: str = "ext_id", insert_if_absent: bool = False) -> DataFrame:
    """rows with those replaced that the batch has a row for; keys that rows don't have are skipped unless insert_if_absent."""
    return upsert(rows, batch if insert_if_absent else batch.join(rows.select(key), key, "left_semi"), key)


def delete(rows: DataFrame, ids: DataFrame, key: str = "ext_id") -> DataFrame:
    """rows without those of the given ids; ids that aren't there change nothing."""
    return rows.join(ids.select(key), key, "left_anti")


def add_unique(rows: DataFrame, batch: DataFrame, key: str = "ext_id") -> DataFrame:
    """rows and the batch's rows; an error, when it is run, if a key comes twice."""
    both = rows.unionByName(batch.select(*rows.columns))
    twice = F.count("*").over(Window.partitionBy(key)) > 1
    checked = F.when(twice, F.raise_error(F.concat(F.lit("duplicate id: "), F.col(key).cast("string"))).cast(both.schema[key].dataType)).otherwise(F.col(key))
    return both.withColumn(key, checked)


def record(docs: DataFrame, batch: DataFrame) -> DataFrame:
    """Documents (doc_id, data, metadata) with the batch's values where they aren't null."""
    new = batch.select(F.col("doc_id"), F.col("data").alias("__data"), F.col("metadata").alias("__metadata"))
    return docs.join(new, "doc_id", "full").select("doc_id", F.coalesce("__data", "data").alias("data"), F.coalesce("__metadata", "metadata").alias("metadata"))


def remove(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents without the given doc_ids."""
    return docs.join(ids.select("doc_id"), "doc_id", "left_anti")


def auto_ids(batch: DataFrame, key: Column, order: str, start: int = 1, strategy: str = "sequential") -> DataFrame:
    """Adds ext_id: the key, or where it is null or empty a number from start on, in order, or auto- and a UUID."""
    gone = F.coalesce(key.isNull() | (key == ""), F.lit(True))
    if strategy == "uuid":
        return batch.withColumn("ext_id", F.when(gone, F.concat(F.lit("auto-"), F.regexp_replace(F.expr("uuid()"), "-", ""))).otherwise(key))
    if strategy != "sequential":
        raise ValueError("strategy must be 'uuid' or 'sequential'")
    new = numbered(batch.where(gone), order).withColumn("ext_id", (F.col("row") + start).cast("string"))
    return batch.where(~gone).withColumn("ext_id", key).unionByName(new.select(*batch.columns, "ext_id"))


def counters(op_log: DataFrame) -> DataFrame:
    """(op, requested): how many rows each kind of operation asked for."""
    return op_log.groupBy("op").agg(F.count("*").alias("requested"))

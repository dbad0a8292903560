"""Spark helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut, cut_by, drop  # noqa: F401  operators import them from here

#: Java and RE2 pattern of the separators between words.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Java and RE2 pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE = 1 << 21  # bytes of text that are worked on at once


def fold(text: Column) -> Column:
    """Text with A-Z (and nothing else) in lower case; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, in order; no words for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def replace(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns; an input column of the same name, in any case, gives way."""
    taken = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *(v.alias(k) for k, v in columns.items()))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Jobs inside send texts to Python in batches of few rows, which take little memory; then the session is as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Gives memory that is no longer in use back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def aside(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on documents for which input columns that begin with __ have other names, so none meets a name of its own."""

    @wraps(work)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        names = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        return work(docs.withColumnsRenamed(names), *args, **named).withColumnsRenamed({v: k for k, v in names.items()})

    return run


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches whose texts are at most so many bytes long together, or of one row, whatever the session's batch size."""
    for b in batches:
        for lo, hi in cuts(b.column(column), most):
            yield b.slice(lo, hi - lo)


def cuts(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Rows from and to, of runs of texts of at most so many bytes together, or of one text; of lists, the elements count."""
    size = pa.compute.list_value_length if pa.types.is_list(texts.type) else pa.compute.binary_length
    at = np.cumsum(size(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        before = at[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(at, before + most, "right")))
        yield lo, hi
        lo = hi


def spread(df: DataFrame) -> DataFrame:
    """A small written table's rows over all cores, where its files would give fewer tasks than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def grouped(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table], out: str, parts: int | None = None) -> DataFrame:
    """work(table) of all rows with equal keys, a bounded number; its tables are the result.  parts: the number of tasks, else Spark's choice."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                got = work(pa.concat_tables(held).combine_chunks())
                held.clear()
                if got.num_rows:
                    yield from got.to_batches()

        for b in batches:
            t = pa.Table.from_batches([b])
            mark = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            at = 0
            for i in range(1, len(mark) + 1):
                if i == len(mark) or mark[i] != mark[at]:
                    if mark[at] != now:
                        yield from flush()
                        now = mark[at]
                    held.append(t.slice(at, i - at))
                    at = i
        yield from flush()

    dealt = rows.repartition(*keys) if parts is None else rows.repartition(parts, *keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(walk, out)


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges lead from src down to dst."""
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    # written, the smallest neighbours have a size that Spark knows: small, they are broadcast; large, hubs are split
    least = cut(both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low")))
    large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src > dst").distinct()
    large = cut(large)
    drop(least)
    least = cut(large.groupBy("src").agg(F.min("dst").alias("low")))
    small = large.join(least, "src").where("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionAll(least.select("src", F.col("low").alias("dst")))
    out = cut(small.distinct())
    drop(large)
    drop(least)
    return out


def _only_stars(edges: DataFrame) -> bool:
    """Whether each source has one destination, which is the source of no edge."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out = 1 and in = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (src long, dst long): rows (node, component).

    Component: the smallest node reachable.  Alternates large-star and small-star
    steps until only stars are left; each step is a min aggregate and an equi join,
    so no component is ever gathered in one task.  Nodes without an edge to another
    node are absent.  No edges: no rows.
    """
    now = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    while not _only_stars(now):
        after = _stars(now)
        drop(now)
        now = after
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionAll(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())

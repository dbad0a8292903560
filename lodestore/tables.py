"""Tables that operators write and read again, in the folder that all executors share.

A written table replaces its lineage: a lost executor never recomputes what lies
before it, and later jobs see one set of rows.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS, PART = 1024, "__part"

_made: dict[str, Any] = {}  # paths of tables, in the order they were made, with the settings of their file system
_named: dict[str, tuple[SparkSession, str]] = {}  # paths of tables that the catalog knows by a name


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or set before; where neither is, a temporary one if all runs on this machine, else an error."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lodestore-')}"
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path in the shared folder that nothing is at, deleted when Python ends."""
    path = f"{shared_dir(spark)}/lodestore-{kind}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(drop_paths)
    _made[path] = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return path


def local(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A DataFrame of a few rows or none, which no executor's Python reads; one made of a list starts a Python process for each core."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    named = [dict(zip(kind.names, r, strict=True)) for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(named, to_arrow_schema(kind)), kind)


def cut(df: DataFrame) -> DataFrame:
    """Writes a DataFrame as a table and reads it from there."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestore_path = path
    return out


def cut_by(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """cut() in so many buckets by a column, so that a join on it moves the other side only."""
    spark = df.sparkSession
    path, name = new_path(spark), f"lodestore_{uuid.uuid4().hex}"
    _named[path] = spark, name
    df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
    out = spark.table(name)
    out._lodestore_path = path
    return out


def cut_parts(df: DataFrame, column: str, parts: int = PARTS) -> DataFrame:
    """cut() in directories by a number modulo `parts` (PART), sorted by it inside; in_parts() reads some numbers' files only."""
    path = new_path(df.sparkSession)
    dealt = df.drop(PART).withColumn(PART, F.pmod(F.coalesce(column, F.lit(0)), F.lit(parts)).cast("int"))
    # large parts are dealt to several tasks
    dealt = dealt.repartition(PART, F.pmod(F.xxhash64(*(c for c in dealt.columns if not dealt.schema[c].dataType.simpleString().startswith("map"))), F.lit(8)))
    dealt.sortWithinPartitions(PART, column).write.partitionBy(PART).option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(dealt.schema).parquet(path)
    out._lodestore_path = path
    return out


def in_parts(df: DataFrame, column: str, numbers: list[int], parts: int = PARTS) -> DataFrame:
    """Rows whose column is one of some numbers."""
    some = df.where(F.col(column).isin(numbers))
    return some.where(F.col(PART).isin(sorted({n % parts for n in numbers}))) if PART in df.columns else some


def path_of(df: DataFrame | None) -> str | None:
    """Where the table of a result of cut() is."""
    return getattr(df, "_lodestore_path", None)


def drop_paths(paths: list[str] | None = None) -> None:
    """Deletes tables; without paths, all there are."""
    for path in list(_made) if paths is None else paths:
        if path in _made:
            jvm, settings = _made.pop(path)
            spark, name = _named.pop(path, (None, ""))
            try:
                if spark is not None and paths is not None:
                    spark.sql(f"DROP TABLE IF EXISTS {name}")
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(settings).delete(where, True)
            except Exception:  # noqa: BLE001  the JVM has ended, and a temporary folder with it
                if paths is not None:
                    raise


def drop(*tables: DataFrame) -> None:
    """Deletes the tables of results of cut() that nothing will read again."""
    drop_paths([p for p in map(path_of, tables) if p])


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes the tables made inside, but for those put in the list, when it ends."""
    before, kept = set(_made), []
    yield kept
    stay = {path_of(t) for t in kept}
    drop_paths([p for p in _made if p not in before and p not in stay])

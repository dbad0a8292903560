"""Dataset scans with explicit schemas, and synthetic vectors."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns that each dataset has, as DDL.
SCHEMAS = {
    "trajectories": "conversation array<struct<`from`:string,value:string>>, conversations array<struct<`from`:string,value:string>>, messages array<struct<`from`:string,value:string>>",
    "chats": "prompt string, messages array<struct<role:string,content:string>>",
    "math_steps": "instruction string, next_response string, answer string",
    "tagged_reasoning": "question string, prompt string, query string, problem string, answer string, generation string",
    "feedback": "instruction string, models array<string>, completions array<struct<response:string,critique:string,overall_score:double,annotations:map<string,string>>>",
    "function_calls": "query string, tools string, answers string",
    "passages": "text_id string, id string, text string, title string",
    "questions": "question string, golden_answers array<string>",
}


def scan(spark: SparkSession, name: str, path: str, kind: str | None = None) -> DataFrame:
    """A dataset's rows, read with its schema; kind: json, parquet, orc, or by the path's ending.

    Unknown names and unreadable paths are RuntimeErrors, raised here.
    """
    if name not in SCHEMAS:
        raise RuntimeError(f"unknown dataset: {name}")
    kind = kind or ("parquet" if path.rstrip("/").endswith(".parquet") else "orc" if path.rstrip("/").endswith(".orc") else "json")
    try:
        out = spark.read.schema(SCHEMAS[name]).format(kind).load(path)
        out.inputFiles()
    except Exception as e:
        raise RuntimeError(f"dataset {name} can't be read from {path}: {e}") from e
    return out.withColumn("__order", F.monotonically_increasing_id())


def synthetic(spark: SparkSession, count: int, dim: int, seed: int = 123, prefix: str = "ins") -> DataFrame:
    """(ext_id, vector): so many standard normal vectors, the same for the same seed, with prefixed ids."""
    share = lambda i, part: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i, F.lit(part)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # two hashed uniform numbers make a normal one, so rows are the same however they are dealt
    entry = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.sqrt(-2 * F.log(share(i, "r"))) * F.cos(2 * math.pi * share(i, "a"))).cast("float"))
    return with_ids(spark.range(count).select(F.col("id").alias("row"), "id", entry.alias("vector")), prefix, "row").select("ext_id", "vector")


def with_ids(rows: DataFrame, prefix: str, number: str) -> DataFrame:
    """Rows with ext_id, the prefix and a number."""
    return rows.withColumn("ext_id", F.concat(F.lit(f"{prefix}-"), F.col(number).cast("string")))


def config(path: str) -> dict:
    """A configuration file: YAML where a YAML library is there, else JSON."""
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


def append_result(rows: DataFrame, path: str) -> None:
    """Appends benchmark rows as CSV files, each with its header."""
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)

"""Document stores: (doc_id, data, metadata) as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mutate import latest
from ..types import DOCS

VALUE = "struct<data:string,metadata:map<string,string>>"


def _document(value) -> dict:
    """Data and metadata of a stored JSON value; a bare value is data."""
    text = F.trim(value)
    wrapped = text.startswith("{") & F.get_json_object(text, "$.data").isNotNull()
    parsed = F.from_json(text, VALUE)
    bare = F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")).otherwise(text)
    return {"data": F.when(wrapped, parsed["data"]).otherwise(bare), "metadata": F.when(wrapped, parsed["metadata"])}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON object {id: value}, a JSON list (ids from 1), or JSON lines with doc_id or id.

    A value is {data, metadata} or anything else, which is then the data.  One file
    of an object or list is one text; stores too large for that are JSON lines.
    """
    head = spark.read.text(path).where(F.trim("value") != "").first()
    start = head["value"].strip()[:1] if head else ""
    lines = spark.read.text(path).where(F.trim("value") != "")
    as_lines = start == "{" and lines.limit(2).where(F.get_json_object("value", "$").isNotNull() & (F.get_json_object("value", "$.doc_id").isNotNull() | F.get_json_object("value", "$.id").isNotNull())).count() > 0
    if as_lines:
        rows = lines.select(F.coalesce(F.get_json_object("value", "$.doc_id"), F.get_json_object("value", "$.id")).alias("doc_id"), *(v.alias(k) for k, v in _document(F.col("value")).items()))
        return rows.where("doc_id is not null")
    whole = spark.read.text(path, wholetext=True)
    if start == "[":
        each = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "value")).select((F.col("pos") + 1).cast("string").alias("doc_id"), "value")
    else:
        each = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("doc_id", "value"))
    return each.select("doc_id", *(v.alias(k) for k, v in _document(F.col("value")).items()))


def write(docs: DataFrame, path: str) -> None:
    """Writes documents as JSON lines, which read() takes back."""
    docs.select("doc_id", "data", "metadata").write.mode("overwrite").json(path)


def from_records(records: DataFrame, order: str = "pos") -> DataFrame:
    """Documents of records (doc_id, data, metadata, pos); rows without an id are skipped, the last of an id stays."""
    return latest(records.where(F.col("doc_id").isNotNull()), "doc_id", order).select("doc_id", "data", "metadata")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)

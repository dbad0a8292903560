"""The corpus pipeline: from documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's docs.  All but the last return the columns of
documents.

All stages take nulls in any column, empty and very long texts, repeated rows, columns
beside those of documents, and empty tables, which stay empty.  Null texts count as
empty ones, and stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import line_dedup, minhash, mixing, pieces, toxicity
from lodestore.tables import cut, drop, scratch

#: DuckDB SQL for the rows of run(); trained models, MinHash and Viterbi have none.
ORACLE_SQL: str | None = None


def _as(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, learned from labels, don't reject.

    Empty texts score like one another, rows that are equal alike; without labels all
    documents score alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _as(toxicity.classify(docs, labels).where("predicted = 0"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites; n_chars follows the text.

    Only documents with near copies, by the test of drop_copies, may stay whole, if
    most of their words would go.  A null source is a site of its own; rows equal in
    id and text lose the same lines; rows without an id have no copies.
    """
    # a group of several has members beside its smallest; so none is counted by its component, in one task
    others = minhash.linked(docs).where("doc_id <> component_id")
    copies = cut(others.select(F.explode(F.array("doc_id", "component_id")).alias("doc_id")).distinct())
    return _as(line_dedup.dedup(docs, copies=copies), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8): that with the smallest id.

    Rows equal in id and text all stay or all go; rows without an id or without words
    all stay.
    """
    return minhash.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for.

    A null source is one more source; documents without words have no size, and rates
    of sources without any are 0, so their documents go.  Rows equal in id and text
    are taken equally often.
    """
    return mixing.mix(docs)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether decoding them gives its text back; null and empty texts have none and do."""
    out = pieces.decode(pieces.encode(docs))
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return out.select("doc_id", "lang", "source", F.size("ids").alias("n_ids"), "ids", same.alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("minhash", drop_copies), ("mixing", mix), ("sentencepiece", to_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch() as kept:  # of what a stage writes, only its result stays
            after = cut(stage(spark, docs, sf_dir))
            kept.append(after)
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

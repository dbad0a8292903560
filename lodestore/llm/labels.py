"""A bounded sample of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sampled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """(doc_id, text, y) for usable labelled rows, about `most` of each class, picked by a hash of the id.

    usable: a condition on doc_id.  Null labels and ids don't count; of several
    labels of one id the largest holds.  At most about 2 * most ids, so their join
    with the documents is a broadcast of proven size.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, F.lit(most / max(most, sizes.get(1, 0)))).otherwise(F.lit(most / max(most, sizes.get(0, 0))))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

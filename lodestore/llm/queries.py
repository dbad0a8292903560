"""The subpackage's queries, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    out = mixing.plan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE["op1_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source
), stops AS (
  SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / weight AS stop FROM sources
), sums AS (
  SELECT *, coalesce(sum(cap) OVER before, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER before, 0)::BIGINT AS weight_before,
    (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weights
  FROM stops WINDOW before AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (total - cap_before)::DOUBLE / (weights - weight_before)::DOUBLE AS here FROM sums
), targets AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, (max(here) FILTER (here <= stop) OVER ()) * weight), cap::DOUBLE) AS target FROM levels
), rates AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rates
"""


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


ORACLE["op3_line_dedup"] = r"""
WITH rows_ AS (SELECT doc_id, text, coalesce('=' || source, 'null') AS site FROM documents),
lines AS (
  SELECT doc_id, site, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows_
), full_ AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
common AS (SELECT line, min({'d': doc_id, 'p': pos}) AS first FROM full_ GROUP BY line HAVING count(DISTINCT site) >= 5),
gone AS (
  SELECT f.doc_id, f.pos FROM full_ f JOIN common c ON f.line = c.line WHERE {'d': f.doc_id, 'p': f.pos} <> c.first
), cutting AS (SELECT doc_id, count(*) AS removed FROM gone GROUP BY doc_id), left_ AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
  WHERE l.doc_id IN (SELECT doc_id FROM cutting) GROUP BY l.doc_id
)
SELECT r.doc_id, CASE WHEN coalesce(length(r.text), 0) > 0 THEN len(string_split(r.text, chr(10))) ELSE 0 END::INT AS n_lines,
  coalesce(c.removed, 0)::INT AS n_removed, CASE WHEN c.doc_id IS NULL THEN r.text ELSE coalesce(l.text, '') END AS text
FROM rows_ r LEFT JOIN cutting c ON r.doc_id = c.doc_id LEFT JOIN left_ l ON r.doc_id = l.doc_id
"""


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    out = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pieces

    out = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return out.select("doc_id", F.size("ids").alias("n_ids"), "ids", same.alias("round_trip"))


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.score(table(spark, sf_dir, "documents"))


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.linked(table(spark, sf_dir, "documents"), width=4)


@query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embed_dedup

    return embed_dedup.linked(table(spark, sf_dir, "embeddings"))


ORACLE["op7_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.a
"""


@query
def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

"""The engine's queries over the test tables, and their SQL where there is one.

vec_id stands for the external id, rows whose id is divisible by 100 are queries, rows
below 16 fixed centroids; scores are rounded to 6 places for comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .functions import keys, metrics, text
from .operators import memories, mutate, search, stats, topology
from .types import CENTROIDS, Metric

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of different lengths, so that the metrics differ."""
    return vectors(spark, sf_dir).withColumn("vector", F.transform("vector", lambda x: (x * (1 + F.col("label"))).cast("float")))


def asked(rows: DataFrame) -> DataFrame:
    return rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


def asking(items: DataFrame) -> DataFrame:
    """The same queries for the engine: items (id, data), with their place."""
    return items.where("id % 100 = 0").select((F.col("id") / 100).cast("long").alias("pos"), "data")


def fixed_centroids(rows: DataFrame) -> DataFrame:
    return rows.where("id < 16").select(F.col("id").cast("int").alias("cluster_id"), F.col("vector").alias("centroid"))


def rounded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "id", (F.round("score", 6) + 0.0).alias("score"))


V = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
W = "WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: (x * (1 + label))::FLOAT)::DOUBLE[] AS e, label FROM embeddings)"
IP = "list_inner_product(v.e, q.e)"
COSINE = "(list_inner_product(v.e, q.e) / ((sqrt(list_inner_product(v.e, v.e)) + 1e-8) * (sqrt(list_inner_product(q.e, q.e)) + 1e-8)))"
L2 = "(-list_distance(v.e, q.e))"


def knn_sql(base: str, score: str, k: int = 10, where: str = "true") -> str:
    return f"""{base}, s AS (SELECT q.id AS query_id, v.id, {score} AS score FROM v, v q WHERE q.id % 100 = 0 AND {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, id, round(score, 6) + 0.0 AS score FROM r WHERE rank <= {k}"""


# -- search --------------------------------------------------------------------


@query(knn_sql(V, IP))
def knn_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return rounded(search.search(rows, asked(rows), 10, "ip"))


@query(knn_sql(W, COSINE))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    return rounded(search.search(rows, asked(rows), 10, "cosine"))


@query(knn_sql(W, L2))
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    return rounded(search.search(rows, asked(rows), 10, "l2"))


@query(knn_sql(W, L2))
def knn_l2_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    return rounded(search.search_expr(rows, asked(rows), 10, "l2"))


@query(f"""{W}, s AS (SELECT q.id AS query_id, v.id, power(list_distance(v.e, q.e), 2) AS d FROM v, v q WHERE q.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, id, round(d, 4) AS distance FROM r WHERE rank <= 10""")
def knn_unified_l2sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    pairs = search.nearest_pairs(rows, asked(rows), 10, Metric.L2)
    far = pairs.select("query_id", "id", F.pow(metrics.score(F.col("vector"), F.col("q"), Metric.L2), 2).alias("far"))  # of the root, as the SQL
    return search.smallest(far, "query_id", 10, F.col("far"), F.col("id")).select("query_id", "rank", "id", F.round("far", 4).alias("distance"))


ASSIGN = "a AS (SELECT v.id, c.id AS cluster_id, row_number() OVER (PARTITION BY v.id ORDER BY round(list_distance(v.e, c.e), 9), c.id) AS rn FROM v, v c WHERE c.id < 16), p AS (SELECT v.*, a.cluster_id FROM v JOIN a ON v.id = a.id AND a.rn = 1)"


@query(f"{V}, {ASSIGN} SELECT id, cluster_id::INT AS cluster_id FROM p")
def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return search.assign(rows, fixed_centroids(rows), "l2").select("id", "cluster_id")


@query(f"""{V}, {ASSIGN}, n AS (SELECT q.id AS query_id, c.id AS cluster_id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_distance(q.e, c.e), 9), c.id) AS rn FROM v q, v c WHERE q.id % 100 = 0 AND c.id < 16),
s AS (SELECT n.query_id, p.id, list_inner_product(p.e, q.e) AS score FROM n JOIN p ON p.cluster_id = n.cluster_id JOIN v q ON q.id = n.query_id WHERE n.rn <= 4),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, id, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 10""")
def ivf_search_nprobe4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    table_ = fixed_centroids(rows)
    placed = tables.cut_parts(search.assign(rows, table_, "l2"), "cluster_id")
    return rounded(search.search(placed, asked(rows), 10, "ip", search.probe(asked(rows), table_, 4, "l2")))


@query(knn_sql(V, IP))
def ivf_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    table_ = fixed_centroids(rows)
    return rounded(search.search_probes(search.assign(rows, table_, "ip"), table_, asked(rows), 10, 16, "ip"))


@query(f"""{V}, {ASSIGN}, s AS (SELECT q.id AS query_id, p.id, -list_distance(p.e, q.e) AS score FROM p, v q WHERE q.id % 100 = 0 AND p.cluster_id IN (0, 3, 7)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, id, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 5""")
def search_on_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    placed = tables.cut_parts(search.assign(rows, fixed_centroids(rows), "l2"), "cluster_id")
    return rounded(search.search_on(placed, asked(rows), [0, 3, 7], 5, "l2"))


@query(knn_sql(V, IP))
def level_merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    q = asked(rows)
    levels = [search.search(rows.where("id % 2 = 0"), q, 10, "ip"), search.search(rows.where("id % 2 <> 0"), q, 10, "ip")]
    return rounded(search.merge(levels, 10))


@query(f"""{V}, s AS (SELECT q.id AS query_id, v.id, v.id % 2 = 0 AS fresh, list_distance(v.e, q.e) AS d FROM v, v q WHERE q.id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rn FROM s WHERE fresh),
stop AS (SELECT query_id FROM n WHERE rn <= 5 GROUP BY query_id HAVING max(d * d) <= 1.45),
pool AS (SELECT s.* FROM s WHERE fresh OR query_id NOT IN (SELECT query_id FROM stop)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM pool)
SELECT query_id, rank::INT AS rank, id, round(-d, 6) + 0.0 AS score FROM r WHERE rank <= 5""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return rounded(search.search_levels(rows.where("id % 2 = 0"), rows.where("id % 2 <> 0"), asked(rows), 5, 1.45, "l2"))


@query(f"""{V}, s AS (SELECT q.id AS query_id, v.id, {IP} AS score FROM v, v q WHERE q.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT r.query_id, r.rank::INT AS rank, r.id, d.text AS data, d.lang FROM r LEFT JOIN documents d ON d.doc_id = r.id WHERE rank <= 5""")
def hydrate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("data"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    hits = search.hydrate(search.search(rows, asked(rows), 5, "ip"), docs)
    return hits.select("query_id", "rank", "id", "data", F.col("metadata")["lang"].alias("lang"))


# -- mutation ------------------------------------------------------------------


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return mutate.delete(rows, rows.where("label = 3").select("id"), "id").select("id", "label")


@query(f"""{V}, s AS (SELECT q.id AS query_id, v.id, {IP} AS score FROM v, v q WHERE q.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT id, label FROM v WHERE id NOT IN (SELECT id FROM r WHERE rank <= 3)""")
def delete_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return search.delete_nearest(rows, asked(rows), 3, "ip")[0].select("id", "label")


OPS = """WITH ops AS (SELECT vec_id AS id, label, 0 AS seq FROM embeddings WHERE vec_id % 2 = 0
UNION ALL SELECT CASE WHEN vec_id % 3 = 0 THEN vec_id % 50 ELSE vec_id END, label + 100, vec_id + 1 FROM embeddings)"""


def _slices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = vectors(spark, sf_dir).select("id", "label")
    to = F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.col("id"))
    batch = rows.select(to.alias("id"), (F.col("label") + 100).alias("label"), (F.col("id") + 1).alias("seq"))
    return rows.where("id % 2 = 0"), mutate.latest(batch, "id", "seq").drop("seq")


@query(f"{OPS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ops) SELECT id, label FROM r WHERE rn = 1")
def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, batch = _slices(spark, sf_dir)
    return mutate.upsert(base, batch, "id")


@query(f"{OPS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ops) SELECT id, label FROM r WHERE rn = 1 AND id % 2 = 0")
def update_existing_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, batch = _slices(spark, sf_dir)
    return mutate.update(base, batch, "id")


@query("SELECT CASE event_type WHEN 'click' THEN 'insert' ELSE event_type END AS op, count(*) AS requested FROM events GROUP BY 1")
def op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "click", "insert").otherwise(F.col("event_type"))
    return mutate.counters(table(spark, sf_dir, "events").select(op.alias("op")))


@query("""SELECT coalesce(n.doc_id, d.doc_id) AS doc_id, coalesce(n.text, d.text) AS data FROM (SELECT * FROM documents WHERE doc_id % 2 = 0) d
FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text || '!' END AS text FROM documents WHERE doc_id % 2 = 1 OR doc_id % 5 > 0) n ON d.doc_id = n.doc_id""")
def record_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("data"), F.lit(None).cast("map<string,string>").alias("metadata"))
    batch = docs.where("doc_id % 2 = 1 or doc_id % 5 > 0").withColumn("data", F.when(F.col("doc_id") % 3 != 0, F.concat("data", F.lit("!"))))
    return mutate.record(docs.where("doc_id % 2 = 0"), batch).select("doc_id", "data")


# -- topology ------------------------------------------------------------------


@query("SELECT label AS cluster_id, count(*) AS live FROM embeddings GROUP BY label")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.cluster_sizes(vectors(spark, sf_dir).withColumnRenamed("label", "cluster_id"))


@query("""WITH e AS (SELECT label AS cluster_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT cluster_id, pos::INT AS pos, round(avg(x::DOUBLE), 4) + 0.0 AS x FROM e GROUP BY ALL""")
def centroid_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumnRenamed("label", "cluster_id")
    zero = rows.select("cluster_id").distinct().withColumn("centroid", metrics.zeros(64))
    moved = topology.moved_centroids(zero, zero.select("cluster_id", F.lit(0).alias("live")), rows)
    return moved.select("cluster_id", F.posexplode("centroid").alias("pos", "x")).select("cluster_id", "pos", (F.round(F.col("x").cast("double"), 4) + 0.0).alias("x"))


@query("SELECT label AS cluster_id, count(*) AS physical, count(*) FILTER (vec_id % 5 > 1) AS live FROM embeddings GROUP BY label HAVING count(*) FILTER (vec_id % 5 > 1) / count(*) < 0.6")
def compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select(F.col("id").alias("ext_id"), F.col("label").alias("cluster_id"))
    return topology.compaction_plan(rows, rows.where("ext_id % 5 <= 1"), 0.6)


@query()
def kmeans_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of trained clusters, by number of probes, over every hundredth row as a query."""
    rows = vectors(spark, sf_dir)
    q = asked(rows)
    table_ = topology.train(rows, "l2", max(1, rows.count() // 16))
    placed = tables.cut_parts(search.assign(rows, table_, "l2"), "cluster_id")
    true = tables.cut(search.search(rows, q, 10, "l2").select("query_id", "id"))
    out = None
    for nprobe in (1, 4, 16):
        got = search.search_probes(placed, table_, q, 10, nprobe, "l2").select("query_id", "id")
        found = true.join(got.withColumn("hit", F.lit(1.0)), ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
        one = found.select(F.lit(nprobe).alias("nprobe"), F.coalesce("recall", F.lit(0.0)).alias("recall"))
        out = one if out is None else out.unionAll(one)
    return out


@query()
def l0_online_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the fresh level that all vectors open and join, in order of their ids."""
    rows = vectors(spark, sf_dir).select("id", "vector")
    none, empty = spark.createDataFrame([], CENTROIDS), spark.createDataFrame([], "cluster_id int, live long")
    placed, _, live = topology.grow(rows, none, empty, "id", "l2", 1.2, cap=32)
    return placed.select("id", "cluster_id").join(F.broadcast(live), "cluster_id").select("id", "cluster_id", "live")


# -- scalar functions, keys ------------------------------------------------------


@query("SELECT doc_id, substr(sha1(doc_id::VARCHAR), 1, 16) AS key FROM documents")
def key_sha1_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", keys.hash_key(F.col("doc_id").cast("string"), "sha1_64").alias("key"))


@query()
def blake2_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", keys.hash_key(F.col("source"), "blake2b64").alias("key"), keys.doc_id(F.col("source")).alias("source_id"), keys.doc_id(F.col("doc_id").cast("string")).alias("number"))


@query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM x),
u AS (SELECT vec_id, generate_subscripts(e, 1) - 1 AS pos, unnest(list_transform(e, lambda y: y / (size + 1e-8))) AS x FROM n)
SELECT vec_id, pos::INT AS pos, round(x, 4) + 0.0 AS x FROM u""")
def norm_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(metrics.normalize(F.col("embedding"))).alias("pos", "x"))
    return rows.select("vec_id", "pos", (F.round(F.col("x").cast("double"), 4) + 0.0).alias("x"))


@query("""WITH f AS (SELECT vec_id, list_concat(embedding, list_transform(range(16), lambda i: 0.0::FLOAT)) AS big, embedding[1:16] AS small FROM embeddings)
SELECT vec_id, len(big) AS n_big, len(small) AS n_small, round(list_sum(big::DOUBLE[]), 5) AS sum_big, round(list_sum(small::DOUBLE[]), 5) AS sum_small FROM f""")
def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", metrics.fit_dim(F.col("embedding"), 80).alias("big"), metrics.fit_dim(F.col("embedding"), 16).alias("small"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")), 5)
    return rows.select("vec_id", F.size("big").cast("long").alias("n_big"), F.size("small").cast("long").alias("n_small"), total("big").alias("sum_big"), total("small").alias("sum_small"))


@query(r"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 160 THEN left(t, 157) || '...' ELSE t END AS summary FROM s""")
def summarize_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.summary(F.col("text")).alias("summary"))


@query()
def tag_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged sections of web pages, which hold tags of all kinds."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.tagged_sections(F.col("html"))).alias("s")).select("page_id", "s.tag", "s.body")


# -- statistics ----------------------------------------------------------------


@query("""SELECT event_type AS kind, count(value) AS n, round(avg(value * 1000), 3) AS mean, round(quantile_cont(value * 1000, 0.5), 3) AS p50,
round(quantile_cont(value * 1000, 0.95), 3) AS p95, round(quantile_cont(value * 1000, 0.99), 3) AS p99, round(max(value * 1000), 3) AS max FROM events GROUP BY event_type""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.latency_summary(table(spark, sf_dir, "events").withColumnRenamed("event_type", "kind"), "value")
    return out.select("kind", "n", *(F.round(c, 3).alias(c) for c in ("mean", "p50", "p95", "p99", "max")))


@query("SELECT sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS inserted, sum(CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END)::BIGINT AS queries, round(count(*) / sum(abs(value)), 6) AS ops_per_sec FROM events")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select((F.col("event_type") == "click").cast("int").alias("inserted"), (F.col("event_type") != "click").cast("int").alias("queries"), F.abs("value").alias("seconds"))
    return stats.throughput(runs).select("inserted", "queries", F.round("ops_per_sec", 6).alias("ops_per_sec"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 256)::BIGINT AS chunk FROM documents")
def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chunked(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 256)


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_id_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.first(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@query("SELECT greatest(coalesce(max(doc_id), 0) + 1, 1) AS next_id FROM documents")
def next_auto_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(keys.next_id(F.col("doc_id").cast("string")).alias("next_id"))


# -- memory texts --------------------------------------------------------------

KEPT = "k AS (SELECT conv_id, turn, lower(trim(role)) AS role, trim(text) AS text FROM conversations WHERE lower(trim(role)) IN ('user', 'assistant') AND trim(text) <> '')"
PAIRS = f"WITH {KEPT}, l AS (SELECT *, lag(role) OVER w AS was, lag(text) OVER w AS asked FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), p AS (SELECT conv_id, turn, asked, text AS answered FROM l WHERE role = 'assistant' AND was = 'user')"


@query(f"{PAIRS} SELECT * FROM p")
def pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories.pair_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).withColumns({"messages": F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))), "conversation": F.transform("turns", lambda t: F.struct(F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"]).alias("from"), t["text"].alias("value")))})


CHAT_ROLE = memories.CHAT_ROLE.replace("'", "''")


@query(f"""{PAIRS}, f AS (SELECT conv_id, arg_min(trim(text), turn) AS prompt FROM conversations WHERE lower(trim(role)) = 'user' AND trim(text) <> '' GROUP BY conv_id),
n AS (SELECT DISTINCT conv_id FROM p), i AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS request_index FROM n)
SELECT i.request_index, (row_number() OVER (PARTITION BY p.conv_id ORDER BY p.turn) - 1)::INT AS trace_index,
'agent role: {CHAT_ROLE}' || chr(10) || ' initial question: ' || coalesce(f.prompt, '') || chr(10) || ' user question: ' || p.asked || chr(10) || ' answer: ' || p.answered AS text
FROM p JOIN i ON p.conv_id = i.conv_id LEFT JOIN f ON f.conv_id = p.conv_id""")
def chat_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversations(spark, sf_dir)
    prompt = F.try_element_at(F.filter("messages", lambda m: (m["role"] == "user") & (F.trim(m["content"]) != "")), F.lit(1))["content"]
    return memories.flatten(memories.chats(rows, "conv_id", prompt, F.col("messages"))).select("request_index", "trace_index", "text")


FIRST = f"WITH {KEPT}, f AS (SELECT conv_id, arg_min(text, turn) AS opening FROM k WHERE role = 'user' GROUP BY conv_id), a AS (SELECT conv_id, opening, array_to_string(list_filter(string_split_regex(opening, '\\s+'), lambda w: w <> '')[1:20], ' ') AS agent FROM f)"


@query(f"{FIRST} SELECT conv_id, agent FROM a")
def agent_key20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversations(spark, sf_dir)
    opening = F.try_element_at(F.filter("conversation", lambda t: (t["from"] == "human") & (text.strip(t["value"]) != "")), F.lit(1))["value"]
    return rows.select("conv_id", text.first_words(text.strip(opening)).alias("agent")).where("agent is not null")


LIMITED = PAIRS + FIRST.removeprefix(f"WITH {KEPT}")


@query(f"""{LIMITED}, n AS (SELECT conv_id, count(*)::INT AS n_trace FROM p GROUP BY conv_id),
r AS (SELECT a.agent, n.n_trace, row_number() OVER (PARTITION BY a.agent ORDER BY a.conv_id) - 1 AS request_index FROM a JOIN n ON a.conv_id = n.conv_id)
SELECT agent, request_index::INT AS request_index, n_trace FROM r WHERE request_index < 2""")
def limit_per_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = memories.trajectories(_conversations(spark, sf_dir), "conv_id", F.col("conversation"), limit=2)
    return out.select("agent", "request_index", F.size("trace").alias("n_trace"))


@query(f"""{PAIRS}, s AS (SELECT *, conv_id * 1000 + turn AS ord, trim(substr(asked, 1, 3)) AS instruction FROM p), g AS (SELECT instruction, min(ord) AS first, count(*) AS n FROM s GROUP BY instruction),
i AS (SELECT *, row_number() OVER (ORDER BY first) - 1 AS request_index FROM g) SELECT request_index, instruction, n::INT AS n_trace FROM i WHERE request_index < 12""")
def limit_distinct_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = memories.pair_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumn("ord", F.col("conv_id") * 1000 + F.col("turn"))
    out = memories.math_steps(pairs, "ord", F.substring("asked", 1, 3), F.col("answered"), F.lit("none"), limit=12)
    return out.select("request_index", "instruction", F.size("trace").alias("n_trace"))


@query("""WITH b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS request_index, item_id, trim(text) AS text FROM benchmark WHERE trim(text) <> '')
SELECT request_index, 'agent role: You are a useful agent to use different tools. Following is the specification to an agent tool you need to use: {"id": ' || item_id || '}' AS tools_text FROM b""")
def function_call_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    tools = F.concat(F.lit('{"id": '), F.col("item_id").cast("string"), F.lit("}"))
    out = memories.function_calls(rows, "item_id", F.col("text"), tools, F.col("text"))
    return out.select("request_index", F.col("trace")[1]["text"].alias("tools_text"))


@query("SELECT count(*) AS n, count(DISTINCT ext_id) AS ids FROM (SELECT coalesce(nullif(CASE WHEN doc_id % 7 = 0 THEN '' ELSE doc_id::VARCHAR END, ''), 'auto-' || doc_id) AS ext_id FROM documents)")
def auto_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("doc_id").cast("string")).alias("raw"))
    top = rows.count() + 1_000_000
    return mutate.auto_ids(rows, F.col("raw"), "doc_id", top).agg(F.count("*").alias("n"), F.count_distinct("ext_id").alias("ids"))


# -- the engine ----------------------------------------------------------------


@query(f"""{V}, s AS (SELECT q.id AS query_id, v.id, {IP} AS score FROM v, v q WHERE q.id % 100 = 0 AND v.id % 10 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR) AS rank FROM s)
SELECT (query_id // 100)::INT AS query_idx, rank::INT AS rank, id::VARCHAR AS ext_id, round(score, 5) + 0.0 AS score FROM r WHERE rank <= 5""")
def engine_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all, delete every tenth, search: through the queue, with vectors as payloads."""
    from .encoders import PassthroughEncoder
    from .plans.engine import Engine

    rows = vectors(spark, sf_dir)
    items = rows.select("id", F.col("vector").alias("data"))
    engine = Engine(spark, PassthroughEncoder(64, normalize=False))
    index = engine.create_index("all", "ip")
    engine.add_insert(index, items)
    engine.add_delete_ids(index, items.where("id % 10 = 0").select("id"))
    engine.add_search(index, asking(items), 5)
    return engine.run().hits.select("query_idx", "rank", "ext_id", F.round("score", 5).alias("score"))

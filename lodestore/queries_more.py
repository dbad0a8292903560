"""More of the engine's queries: builders' full texts, sources, keys, documents, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys, metrics, text
from .operators import memories, mutate, search, stats, topology
from .queries import ASSIGN, COSINE, FIRST, IP, L2, ORACLE, PAIRS, QUERIES, V, W, _conversations, asked, asking, fixed_centroids, query, scaled, table, vectors
from .tables import new_path
from .types import VECTORS, Op


# -- builders --------------------------------------------------------------------


@query(rf"""{PAIRS}{FIRST[FIRST.index(", f AS"):]}, n AS (SELECT conv_id FROM p GROUP BY conv_id),
i AS (SELECT a.*, row_number() OVER (PARTITION BY a.agent ORDER BY a.conv_id) - 1 AS request_index FROM a JOIN n ON a.conv_id = n.conv_id)
SELECT i.agent, i.request_index::INT AS request_index, (row_number() OVER (PARTITION BY p.conv_id ORDER BY p.turn) - 1)::INT AS trace_index,
'agent role: ' || trim(regexp_extract(i.opening, '^(?s)(.*?[.!?。！？])\s', 1) || CASE WHEN regexp_matches(i.opening, '[.!?。！？]\s') THEN '' ELSE i.opening END) || chr(10) || 'human question: ' || p.asked || chr(10) || 'gpt answer: ' || p.answered AS text
FROM p JOIN i ON p.conv_id = i.conv_id""")
def trajectory_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = memories.trajectories(_conversations(spark, sf_dir), "conv_id", F.col("conversation"))
    return memories.flatten(out).select("agent", "request_index", "trace_index", "text")


@query(f"""{PAIRS}, s AS (SELECT conv_id * 1000 + turn AS ord, asked, answered, min(conv_id * 1000 + turn) OVER (PARTITION BY asked) AS first FROM p)
SELECT dense_rank() OVER (ORDER BY first) - 1 AS request_index, (row_number() OVER (PARTITION BY asked ORDER BY ord) - 1)::INT AS trace_index,
'agent role: {memories.STEPS_ROLE}' || chr(10) || 'question: ' || asked || chr(10) || 'response: ' || answered || CASE WHEN ord % 2 = 0 THEN chr(10) || 'answer: ' || ord ELSE '' END AS text FROM s""")
def math_step_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = memories.pair_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumn("ord", F.col("conv_id") * 1000 + F.col("turn"))
    answer = F.when(F.col("ord") % 2 == 0, F.col("ord").cast("string")).otherwise(F.lit("None"))
    out = memories.math_steps(pairs, "ord", F.col("asked"), F.col("answered"), answer)
    return memories.flatten(out).select("request_index", "trace_index", "text")


@query("""WITH b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS request_index, item_id, trim(text) AS q FROM benchmark WHERE trim(text) <> ''),
m AS (SELECT *, unnest([1, 2]) AS n FROM b), t AS (SELECT request_index, n, unnest(generate_series(0, 5)) AS k, q, item_id FROM m)
SELECT request_index, ((n - 1) * 6 + k)::INT AS trace_index, CASE k
WHEN 0 THEN 'agent role: You are a useful agent to solve user questions. question: ' || q || ' model: m' || n || ' answer: ' || q || n
WHEN 1 THEN 'agent role: You are a agent to criticize the response to a given question. critique: c' || n || ', overall_score: ' || (item_id + 0.5)::DOUBLE
ELSE 'agent role: You are a agent to evaluate the ' || ['helpfulness', 'honesty', 'instruction_following', 'truthfulness'][k - 1] || ' of a given response. evaluation: ' || CASE WHEN k = 3 THEN item_id::VARCHAR ELSE '' END END AS text FROM t""")
def feedback_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    one = lambda n: F.struct(F.concat(F.trim("text"), F.lit(str(n))).alias("response"), F.lit(f"c{n}").alias("critique"), (F.col("item_id") + 0.5).alias("overall_score"), F.create_map(F.lit("honesty"), F.col("item_id").cast("string")).alias("annotations"))
    out = memories.feedback(rows, "item_id", F.col("text"), F.array(*map(F.lit, ("m1", "m2", "m3"))), F.array(one(1), one(2)))
    return memories.flatten(out).select("request_index", "trace_index", "text")


@query(f"""WITH b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS request_index, trim(text) AS q FROM benchmark WHERE trim(text) <> ''), t AS (SELECT *, unnest([0, 1]) AS k FROM b)
SELECT request_index, k::INT AS trace_index, 'agent role: {memories.TAGGED_ROLE}' || chr(10) || 'question: ' || q || chr(10) || CASE k WHEN 0 THEN 'answer: [thinking] ' || q ELSE 'answer: [output] done' || chr(10) || 'ground truth answer: 42' END AS text FROM t""")
def tagged_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    generation = F.concat(F.lit("<thinking>\n"), F.col("text"), F.lit("</thinking> <output>done<\\output> <empty> </empty> <open>x</shut>"))
    out = memories.tagged_reasoning(rows, "item_id", F.col("text"), F.lit("42"), generation)
    return memories.flatten(out).select("request_index", "trace_index", "text")


@query("""WITH k AS (SELECT doc_id, text, lang, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 400)::VARCHAR END AS tid, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents),
f AS (SELECT *, coalesce(tid, row::VARCHAR) AS id FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row) AS rn FROM f) SELECT id, doc_id AS source_row, lang AS title FROM r WHERE rn = 1 ORDER BY row LIMIT 300""")
def passages_first_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tid = F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 400).cast("string"))
    rows = table(spark, sf_dir, "documents").select("doc_id", tid.alias("text_id"), F.lit(None).cast("string").alias("id"), F.col("lang").alias("title"), F.concat(F.lit("x"), "text").alias("text"))
    out = memories.first_per_id(rows, "doc_id", 300)
    numbers = stats.numbered(rows.select("doc_id"), "doc_id")
    return out.join(numbers, "row").select("id", F.col("doc_id").alias("source_row"), F.col("metadata")["title"].alias("title"))


@query("SELECT trim(text) AS question, 'a' || item_id AS answer FROM benchmark WHERE item_id % 3 <> 0 AND trim(text) <> '' ORDER BY item_id LIMIT 20")
def question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = F.when(F.col("item_id") % 3 != 0, F.array(F.concat(F.lit("a"), F.col("item_id")), F.lit("other"))).otherwise(F.array().cast("array<string>"))
    return memories.questions(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), golden.alias("golden_answers")), "item_id", 20)


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN trim(text) ELSE 'u' || turn || CASE WHEN turn % 2 = 0 THEN ' a' ELSE '' END END AS joined, CASE WHEN turn % 3 = 0 THEN trim(text) ELSE 'u' || turn END AS first FROM conversations""")
def entry_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    own, fields = F.when(F.col("turn") % 3 == 0, F.col("text")), [F.concat(F.lit("u"), F.col("turn")), F.when(F.col("turn") % 2 == 0, F.lit("a"))]
    return rows.select("conv_id", "turn", memories.entry_text(own, fields, True).alias("joined"), memories.entry_text(own, fields, False).alias("first"))


@query("SELECT conv_id, count(*) AS n, list(text ORDER BY turn)[1] AS first FROM conversations GROUP BY conv_id")
def nested_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests nested under their agent; here an agent is a conversation and a request a turn."""
    rows = table(spark, sf_dir, "conversations")
    requests = rows.select(F.col("conv_id").alias("agent"), F.lit(None).cast("string").alias("agent_role"), F.col("turn").alias("request_index"), F.array(F.struct("text")).alias("trace"))
    return memories.agents(requests).select(F.col("agent").alias("conv_id"), F.size("requests").cast("long").alias("n"), F.col("requests")[0]["trace"][0]["text"].alias("first"))


@query("""SELECT page_id, regexp_extract(t, '^(?s)(.*?[.!?])\\s', 1) || CASE WHEN regexp_matches(t, '[.!?]\\s') THEN '' ELSE t END AS first FROM (SELECT page_id, 'Page ' || page_id || '. ' || url || '! end' AS t FROM pages)""")
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("Page "), F.col("page_id"), F.lit(". "), F.col("url"), F.lit("! end"))
    return table(spark, sf_dir, "pages").select("page_id", text.first_sentences(t).alias("first"))


@query("SELECT agent, request_index, trace_index, text FROM (SELECT conv_id AS agent, turn AS request_index, 0 AS trace_index, text FROM conversations) ORDER BY agent, request_index LIMIT 50")
def flatten_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return memories.flatten(rows.select(F.col("conv_id").alias("agent"), F.col("turn").alias("request_index"), F.array(F.struct("text")).alias("trace")), 50)


# -- metrics, results --------------------------------------------------------------


@query(f"{W} SELECT v.id, round(1 - list_cosine_similarity(v.e, q.e), 6) + 0.0 AS cosine, round(-list_inner_product(v.e, q.e), 5) + 0.0 AS ip, round(power(list_distance(v.e, q.e), 2), 4) + 0.0 AS l2 FROM v, v q WHERE q.id = 0")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    pairs = rows.select("id", "vector").join(F.broadcast(rows.where("id = 0").select(F.col("vector").alias("q"))))
    far = lambda metric, n: (F.round(metrics.distance(F.col("vector"), F.col("q"), metric), n) + 0.0).alias(metric)
    return pairs.select("id", far("cosine", 6), far("ip", 5), far("l2", 4))


@query(f"""{W}, s AS (SELECT q.id AS query_id, v.id, {L2} AS score FROM v, v q WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, round(max(score * score), 4) AS kth FROM r WHERE rank <= 10 GROUP BY query_id""")
def kth_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    return search.kth_distance(search.search(rows, asked(rows), 10, "l2")).select("query_id", F.round("kth", 4).alias("kth"))


@query(f"""{W}, s AS (SELECT q.id AS query_id, v.id, {COSINE} AS score FROM v, v q WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, string_agg(id, ',' ORDER BY rank) AS ids FROM r WHERE rank <= 5 GROUP BY query_id""")
def nested_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    hits = search.nest(search.search(rows, asked(rows), 5, "cosine"))
    return hits.select("query_id", F.array_join(F.transform("hits", lambda h: h["id"].cast("string")), ",").alias("ids"))


@query("SELECT vec_id AS id, label::VARCHAR AS tag, 'p' || vec_id AS data FROM embeddings")
def payload_in_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", F.create_map(F.lit("tag"), F.col("label").cast("string")).alias("metadata"), F.concat(F.lit("p"), F.col("id")).alias("payload"))
    return search.with_payload(rows).select("id", F.col("metadata")["tag"].alias("tag"), F.col("metadata")["_data"].alias("data"))


@query(f"{V}, d AS (SELECT v.id, c.id AS cluster_id, row_number() OVER (PARTITION BY v.id ORDER BY round(-list_inner_product(v.e, c.e), 9), c.id) AS rn FROM v, v c WHERE v.id % 100 = 0 AND c.id < 16) SELECT id AS query_id, cluster_id::INT AS cluster_id FROM d WHERE rn <= 3")
def probe_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return search.probe(asked(rows), fixed_centroids(rows), 3, "ip")


# -- topology ------------------------------------------------------------------


@query("SELECT vec_id::INT AS cluster_id, CASE WHEN vec_id = 3 THEN 64 WHEN vec_id = 16 THEN 128 ELSE 0 END AS total FROM embeddings WHERE vec_id <= 16")
def routing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed table with one centroid changed and one added."""
    new, _ = topology.add_cluster(topology.set_centroid(fixed_centroids(vectors(spark, sf_dir)), 3, [1.0] * 64), [2.0] * 64)
    total = F.when(F.col("cluster_id").isin(3, 16), F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x).cast("int")).otherwise(0)
    return new.select("cluster_id", total.alias("total"))


@query("SELECT vec_id AS id, label AS cluster_id FROM embeddings WHERE label < 6")
def fewer_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shorter routing table drops the clusters beyond it."""
    placed = vectors(spark, sf_dir).select("id", F.col("label").alias("cluster_id"))
    return topology.set_centroids(topology.zero_centroids(spark, 6, 64), placed)[1].select("id", "cluster_id")


@query("SELECT vec_id::VARCHAR AS ext_id, CASE WHEN label = 4 THEN 0 ELSE label END AS cluster_id FROM embeddings WHERE label <> 0")
def dump_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump by label, with one cluster's contents replaced, read back."""
    from .sources import dumps

    rows = vectors(spark, sf_dir).select(F.col("id").cast("string").alias("ext_id"), "vector", F.col("label").alias("cluster_id"))
    path = new_path(spark, "query")
    dumps.write(path, rows, topology.zero_centroids(spark, 10, 64), "ip", 64)
    dumps.replace_cluster(path, 0, rows.where("cluster_id = 4").select("ext_id", "vector"))
    got = dumps.read(spark, path).vectors
    return got.where("cluster_id <> 4").select("ext_id", "cluster_id")


# -- documents, keys -----------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS doc_id, text AS data, lang FROM documents WHERE doc_id % 4 <> 0")
def docstore_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import docstore

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("data"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    path = new_path(spark, "query")
    docstore.write(mutate.remove(docs, docs.where("doc_id % 4 = 0").select("doc_id")), path)
    return docstore.read(spark, path).select("doc_id", "data", F.col("metadata")["lang"].alias("lang"))


@query("SELECT doc_id % 100 AS doc_id, arg_max(text, doc_id) AS data FROM documents GROUP BY doc_id % 100")
def documents_from_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import docstore

    records = table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("doc_id"), F.col("text").alias("data"), F.lit(None).cast("map<string,string>").alias("metadata"), F.col("doc_id").alias("pos"))
    return docstore.from_records(records).select("doc_id", "data")


@query("SELECT doc_id, (doc_id - 500)::VARCHAR AS number FROM documents")
def numeric_doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.when(F.col("doc_id") >= 500, F.concat(F.lit("+00"), F.col("doc_id") - 500)).otherwise((F.col("doc_id") - 500).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", keys.doc_id(spelled).alias("number"))


@query("SELECT 'ins-' || vec_id AS ext_id, len(embedding) AS dim FROM embeddings")
def prefixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import datasets

    return datasets.with_ids(table(spark, sf_dir, "embeddings"), "ins", "vec_id").select("ext_id", F.size("embedding").cast("long").alias("dim"))


@query("SELECT vec_id AS id, label FROM embeddings")
def append_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", "label")
    return mutate.add_unique(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "id")


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS ordinal FROM events")
def request_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("user_id", "event_id", stats.ordinal([F.col("user_id")], [F.col("ts"), F.col("event_id")]).alias("ordinal"))


# -- the engine and the stream -------------------------------------------------------

FOLD = """WITH ops AS (SELECT event_id AS seq, (user_id % 97)::VARCHAR AS ext_id, CASE event_id % 4 WHEN 0 THEN 'delete_ids' WHEN 1 THEN 'update' ELSE 'insert' END AS op FROM events),
d AS (SELECT ext_id, max(seq) FILTER (op = 'delete_ids') AS dead, max(seq) FILTER (op = 'insert') AS born, max(seq) AS last, arg_max(op, seq) AS op FROM ops GROUP BY ext_id)
SELECT ext_id, 'v' || last AS payload FROM d WHERE op <> 'delete_ids' AND born IS NOT NULL AND (dead IS NULL OR born > dead)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 4 == 0, Op.DELETE_IDS.value).when(F.col("event_id") % 4 == 1, Op.UPDATE.value).otherwise(Op.INSERT.value)
    return rows.select(F.col("event_id").alias("seq"), F.lit(0).alias("pos"), op.alias("op"), (F.col("user_id") % 97).cast("string").alias("ext_id"), F.array(F.lit(1.0).cast("float")).alias("vector"), F.lit(None).cast("map<string,string>").alias("metadata"), F.concat(F.lit("v"), F.col("event_id")).alias("payload"))


@query(FOLD)
def fold_op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.fold import fold

    return fold(spark.createDataFrame([], VECTORS), _log(spark, sf_dir)).select("ext_id", "payload")


@query(FOLD)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log, offered in three parts, streamed, flushed and compacted half-way."""
    from .streaming.ingest import Ingest

    s = Ingest(spark, new_path(spark, "query"), new_path(spark, "query"), max_files=4)
    log = _log(spark, sf_dir)
    top = log.agg(F.max("seq")).first()[0] or 0
    for k in range(3):
        s.offer(log.where((F.col("seq") > top * k // 3 - (k == 0)) & (F.col("seq") <= top * (k + 1) // 3)))
        s.flush()
        if k == 1:
            s.compact(1.0)
    return s.snapshot().select("ext_id", "payload")


def _engine_hits(spark: SparkSession, sf_dir: str, strategy: str, **options: float) -> DataFrame:
    from .encoders import PassthroughEncoder
    from .plans.engine import Engine

    items = vectors(spark, sf_dir).select("id", F.col("vector").alias("data"))
    e = Engine(spark, PassthroughEncoder(64, normalize=False), strategy=strategy, nprobe=10**6)
    index = e.create_index("i", "ip", **options)
    e.add_insert(index, items.where("id % 2 = 0"))
    e.add_insert(index, items.where("id % 2 = 1"))
    e.add_search(index, asking(items), 5)
    return e.run().hits.select("query_idx", "rank", "ext_id", F.round("score", 5).alias("score"))


HITS_SQL = f"""{V}, s AS (SELECT q.id AS query_id, v.id, {IP} AS score FROM v, v q WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR) AS rank FROM s)
SELECT (query_id // 100)::INT AS query_idx, rank::INT AS rank, id::VARCHAR AS ext_id, round(score, 5) + 0.0 AS score FROM r WHERE rank <= 5"""


@query(HITS_SQL)
def engine_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine_hits(spark, sf_dir, "ivf")


@query(HITS_SQL)
def engine_multilevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine_hits(spark, sf_dir, "multilevel", clusters=1, max_clusters=8, new_threshold=0.2)


@query(f"{V}, {ASSIGN} SELECT id::VARCHAR AS ext_id, cluster_id::INT AS cluster_id FROM p WHERE label <> 3")
def stream_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, streamed to the clusters of their nearest centroids, then those of a label deleted, with a maintenance pass after each."""
    from .streaming.ingest import Ingest
    from .streaming.maintenance import Maintenance

    rows = vectors(spark, sf_dir)
    s = Ingest(spark, new_path(spark, "query"), new_path(spark, "query"), capacity=1, centroids=fixed_centroids(rows))
    m = Maintenance({"routed": s}, ratio=1.0)
    none = F.lit(None)
    log = rows.select(F.col("id").alias("seq"), F.lit(0).alias("pos"), F.lit(Op.INSERT.value).alias("op"), F.col("id").cast("string").alias("ext_id"), "vector", none.cast("map<string,string>").alias("metadata"), none.cast("string").alias("payload"), "label")
    gone = log.where("label = 3").withColumns({"seq": F.col("seq") + 10**9, "op": F.lit(Op.DELETE_IDS.value), "vector": none.cast("array<float>")})
    for part in (log, gone):
        s.offer(part.drop("label"))
        s.flush()
        m.once()
    return s.snapshot().select("ext_id", "cluster_id")


@query(f"""{V}, u AS (SELECT id, CASE WHEN id % 3 = 0 THEN list_transform(e, lambda x: -x) ELSE e END AS e FROM v WHERE id % 7 <> 0),
s AS (SELECT q.id AS query_id, u.id, list_inner_product(u.e, q.e) AS score FROM u, v q WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR) AS rank FROM s)
SELECT id::VARCHAR AS ext_id, round(e[1], 5) + 0.0 AS first_part FROM u WHERE id NOT IN (SELECT id FROM r WHERE rank <= 3)""")
def engine_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors inserted; a third updated, and as many ids that aren't there; a seventh deleted; then the nearest of each query."""
    from .encoders import PassthroughEncoder
    from .plans.engine import Engine

    items = vectors(spark, sf_dir).select("id", F.col("vector").alias("data"))
    turned = items.where("id % 3 = 0").withColumn("data", F.transform("data", lambda x: -x))
    e = Engine(spark, PassthroughEncoder(64, normalize=False))
    index = e.create_index("i", "ip")
    e.add("insert", index, items)
    e.add("update", index, turned)
    e.add("update", index, turned.withColumn("id", F.concat(F.lit("absent-"), "id")))
    e.add("delete_ids", index, items.where("id % 7 = 0").drop("data"))
    e.add("delete_knn", index, asking(items), k=3)
    e.run()
    return e.resolve(index).rows.select("ext_id", (F.round(F.get("vector", F.lit(0)).cast("double"), 5) + 0.0).alias("first_part"))


@query()
def workload_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies of a workload that inserts all rows and searches every other one, in a ratio of one to two, in 32 batches of each."""
    from .encoders import PassthroughEncoder
    from .plans import workload
    from .plans.engine import Engine

    rows = workload.Stored.of(vectors(spark, sf_dir).select("id", F.col("vector").alias("data")), "id")
    size = max(16, -(-len(rows) // 64))
    e = Engine(spark, PassthroughEncoder(64, normalize=False))
    return stats.latency_summary(workload.drive(e, e.create_index("w", "ip"), rows, rows[::2], "ratio", insert_batch=2 * size, search_batch=size, ratio=(1, 2)))

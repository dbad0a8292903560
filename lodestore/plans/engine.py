"""The engine: collections, a queue of requests, and runs that replay it in order."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..encoders import Encoder
from ..functions import keys
from ..operators import mutate, search, stats, topology
from ..sources import docstore, dumps
from ..types import CATALOG, DOCS, HITS, VECTORS, Metric, Op
from .fold import fold
from .strategies import STRATEGIES

LEVELS = (0, 1, 2)
NPROBE = 32
LOG = "seq long, pos int, op string, ext_id string, vector array<float>, metadata map<string,string>, payload string"


@dataclass
class Collection:
    index_id: int
    name: str
    metric: Metric
    dim: int
    strategy: str
    options: dict[str, Any]
    rows: DataFrame
    centroids: DataFrame | None = None
    levels: dict[int, DataFrame] = field(default_factory=dict)  # routing tables of the levels above the fresh one
    loaded: DataFrame | None = None
    next_auto: int = 1


@dataclass
class Request:
    op: Op
    index_id: int
    rows: DataFrame  # pos, id, data, metadata
    size: int  # above every pos
    k: int = 0
    nprobe: int | None = None
    request_id: str | None = None

    def joins(self, other: Request) -> bool:
        """Whether the next request can run together with this one; deletes of neighbours see each other's work, so never."""
        same = self.op is other.op and self.index_id == other.index_id and self.op is not Op.DELETE_KNN
        return same and (self.op is not Op.SEARCH or (self.k, self.nprobe, self.request_id) == (other.k, other.nprobe, other.request_id))


@dataclass
class RunResult:
    """requested: rows that each kind of operation asked for; affected: rows that deletes of neighbours took; hits: HITS rows."""

    requested: dict[str, int] = field(default_factory=dict)
    affected: dict[str, int] = field(default_factory=dict)
    hits: DataFrame | None = None

    def searches(self) -> dict[str, list[list[tuple[str, float, dict | None]]]]:
        """Hits by request id, one list for each query, on the driver."""
        out: dict[str, list[list]] = {}
        for r in self.hits.orderBy("request_id", "query_idx", "rank").collect():
            lists = out.setdefault(r["request_id"], [])
            while len(lists) <= r["query_idx"]:
                lists.append([])
            lists[r["query_idx"]].append((r["ext_id"], r["score"], r["metadata"]))
        return out


class Engine:
    """Collections of embedded items under one encoder.

    Requests queue up and run() replays them strictly in order: a search sees exactly
    the requests before it.  All payloads of a run are encoded in one pass; runs of
    mutations are folded into one aggregation; results are written and read again, so
    lineage stays short and survives lost executors.
    """

    def __init__(self, spark: SparkSession, encoder: Encoder, strategy: str = "exact", nprobe: int = NPROBE, hash_mode: str = "none", hash_prefix: str = "", auto_id: str = "sequential", insert_if_absent: bool = False) -> None:
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy: {strategy}")
        if encoder.dim <= 0:
            raise ValueError(f"vectors need a positive dimension: {encoder.dim}")
        if hash_mode not in keys.MODES:
            raise ValueError(f"unknown hash mode: {hash_mode}")
        if auto_id not in ("sequential", "uuid"):
            raise ValueError(f"unknown auto id policy: {auto_id}")
        self.spark, self.encoder, self.strategy, self.nprobe = spark, encoder, strategy, nprobe
        self.hash_mode, self.hash_prefix, self.auto_id, self.insert_if_absent = hash_mode, hash_prefix, auto_id, insert_if_absent
        self.collections: dict[int, Collection] = {}
        self.names: dict[str, int] = {}
        self.queue: list[Request] = []
        self.hooks: list[Any] = []
        self.written: list[DataFrame] = []
        self.results: list[DataFrame] = []  # hits of runs, which stay until close()

    # -- catalog ---------------------------------------------------------------

    def create_index(self, name: str, metric: Metric | str = Metric.COSINE, **options: Any) -> int:
        """A new collection; a name used again leads to the new one."""
        index_id = len(self.collections)
        empty = tables.local(self.spark, [], VECTORS)
        made = Collection(index_id, str(name), Metric.parse(metric), self.encoder.dim, self.strategy, options, empty)
        if STRATEGIES[self.strategy].placed:
            made.centroids = topology.zero_centroids(self.spark, 1, made.dim)
            made.rows = empty.withColumns({"cluster_id": F.lit(None).cast("int"), "level": F.lit(None).cast("int")})
        self.collections[index_id], self.names[str(name)] = made, index_id
        return index_id

    def resolve(self, handle: int | str) -> Collection:
        """A collection by id or name; KeyError for an unknown one."""
        index_id = handle if isinstance(handle, int) else self.names[handle]
        return self.collections[index_id]

    def catalog(self) -> DataFrame:
        rows = [(c.index_id, c.name, c.dim, c.metric.value, c.strategy, {k: str(v) for k, v in c.options.items()}) for c in self.collections.values()]
        return self.spark.createDataFrame(rows, CATALOG)

    def info(self, handle: int | str) -> dict[str, Any]:
        c = self.resolve(handle)
        return {"dim": c.dim, "metric": c.metric, "normalized": c.metric is Metric.COSINE, "nlist": 0 if c.centroids is None else topology.nlist(c.centroids), "rows": c.rows.count()}

    def set_centroids(self, handle: int | str, centroids: DataFrame) -> None:
        """Gives a collection a routing table (cluster_id, centroid); its rows are placed by it."""
        c = self.resolve(handle)
        self._fits(c, centroids)
        c.centroids = centroids
        c.rows = self._cut(topology.place(c.rows.drop("cluster_id", "level"), c.centroids, c.metric, 2))

    def set_level_centroids(self, handle: int | str, level: int, centroids: DataFrame) -> None:
        """Gives one level of a collection its routing table; the level's rows are placed by it.  An empty table changes nothing."""
        c = self.resolve(handle)
        if c.strategy != "multilevel" or level not in LEVELS:
            raise ValueError(f"no level {level} in collection {c.name}")
        if centroids.isEmpty():
            return
        self._fits(c, centroids)
        if level == 0:
            c.centroids = centroids
        else:
            c.levels[level] = centroids
        mine = topology.place(c.rows.where(F.col("level") == level).drop("cluster_id", "level"), centroids, c.metric, level)
        c.rows = self._cut(c.rows.where(F.col("level") != level).unionByName(mine.select(*c.rows.columns)))

    @staticmethod
    def _fits(c: Collection, centroids: DataFrame) -> None:
        if not centroids.where(F.coalesce(F.size("centroid"), F.lit(-1)) != c.dim).isEmpty():
            raise ValueError(f"centroids of collection {c.name} must have {c.dim} components")

    def train(self, handle: int | str, rows_per_cluster: int = topology.ROWS_PER_CLUSTER) -> None:
        """Learns a routing table from a collection's rows."""
        c = self.resolve(handle)
        self.set_centroids(handle, topology.train(c.rows, c.metric, rows_per_cluster))

    # -- queue -----------------------------------------------------------------

    def _rows(self, items: DataFrame | Iterable[Any]) -> tuple[DataFrame, int]:
        """(pos, id, data, metadata) of a DataFrame with those columns, or of tuples, dicts or bare payloads, and a number above every pos.

        A DataFrame without pos gets ascending ones, with gaps.
        """
        if isinstance(items, DataFrame):
            named = {c: F.col(c) if c in items.columns else F.lit(None) for c in ("id", "data", "metadata")}
            own = "pos" in items.columns
            pos = F.col("pos").cast("long") if own else F.monotonically_increasing_id()
            rows = items.select(pos.alias("pos"), named["id"].cast("string").alias("id"), named["data"].alias("data"), named["metadata"].cast("map<string,string>").alias("metadata"))
            return rows, rows.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0] if own else max(1, rows.rdd.getNumPartitions()) << 33
        out = []
        for pos, item in enumerate(items):
            if isinstance(item, dict) and "data" in item:
                one = item.get("id"), item["data"], item.get("metadata")
            elif isinstance(item, tuple):
                one = (*item, None, None)[:3]
            else:
                one = None, item, None
            out.append((pos, None if one[0] is None else str(one[0]), self._payload(one[1]), None if one[2] is None else {str(k): str(v) for k, v in one[2].items()}))
        kind = "array<float>" if out and isinstance(out[0][2], list) else "string"
        return self.spark.createDataFrame(out, f"pos long, id string, data {kind}, metadata map<string,string>"), len(out)

    @staticmethod
    def _payload(data: Any) -> Any:
        import json

        if isinstance(data, np.ndarray):
            data = data.tolist()
        if isinstance(data, list) and all(isinstance(x, (int, float)) for x in data):
            return [float(x) for x in data]
        return json.dumps(data, sort_keys=True, ensure_ascii=False) if isinstance(data, (dict, list)) else None if data is None else str(data)

    def add(self, kind: str, index: int | str, items: Any, **named: Any) -> Any:
        """Queues a request of a kind by name; one that isn't known is skipped, with a warning."""
        known = {"insert": self.add_insert, "update": self.add_update, "delete_ids": self.add_delete_ids, "delete_knn": self.add_delete_knn, "search": self.add_search}
        kind = kind.value if isinstance(kind, Op) else kind
        if kind not in known:
            warnings.warn(f"skipped a request of unknown kind {kind}", stacklevel=2)
            return None
        return known[kind](index, items, **named)

    def add_insert(self, index: int | str, items: Any) -> None:
        self.queue.append(Request(Op.INSERT, self.resolve(index).index_id, *self._rows(items)))

    def add_update(self, index: int | str, items: Any) -> None:
        self.queue.append(Request(Op.UPDATE, self.resolve(index).index_id, *self._rows(items)))

    def add_delete_ids(self, index: int | str, ids: Iterable[Any] | DataFrame) -> None:
        rows = ids if isinstance(ids, DataFrame) else [(i, None, None) for i in ids]
        self.queue.append(Request(Op.DELETE_IDS, self.resolve(index).index_id, *self._rows(rows)))

    def add_delete_knn(self, index: int | str, queries: Any, k: int) -> None:
        self.queue.append(Request(Op.DELETE_KNN, self.resolve(index).index_id, *self._rows(queries), k))

    def add_search(self, index: int | str, queries: Any, k: int, request_id: str | None = None, nprobe: int | None = None) -> str:
        """Queues a search and gives its request id; nprobe, if given, is positive.

        Queries of a DataFrame without pos are numbered without gaps.
        """
        if nprobe is not None and nprobe <= 0:
            raise ValueError("nprobe must be positive")
        if isinstance(queries, DataFrame) and "pos" not in queries.columns:
            queries = stats.numbered(self._cut(queries.withColumn("__at", F.monotonically_increasing_id())), "__at").withColumnRenamed("row", "pos")
        request_id = request_id or uuid.uuid4().hex
        self.queue.append(Request(Op.SEARCH, self.resolve(index).index_id, *self._rows(queries), k, nprobe, request_id))
        return request_id

    # -- run -------------------------------------------------------------------

    def run(self) -> RunResult:
        """Replays the queue in order and empties it."""
        queue, self.queue = self.queue, []
        result = RunResult(hits=tables.local(self.spark, [], HITS))
        pending: dict[int, list[DataFrame]] = {}
        for request, rows, n in self._encoded(self._coalesced(queue)):
            c = self.collections[request.index_id]
            result.requested[request.op.value] = result.requested.get(request.op.value, 0) + n
            if request.op in (Op.INSERT, Op.UPDATE, Op.DELETE_IDS):
                pending.setdefault(c.index_id, []).append(self._keyed(c, request, rows))
                continue
            self._settle(c, pending)
            queries = rows.select(F.col("pos").alias("query_id"), "vector")
            if request.op is Op.SEARCH:
                result.hits = result.hits.unionByName(self._hits(c, request, queries))
            else:
                gone = self._cut(search.delete_nearest(c.rows.withColumnRenamed("ext_id", "id"), queries, request.k, c.metric)[1])
                result.affected[request.op.value] = result.affected.get(request.op.value, 0) + gone.count()
                gone = gone.withColumnRenamed("id", "ext_id")
                c.rows = self._cut(mutate.delete(c.rows, gone).select(*c.rows.columns))
                if c.loaded is not None:
                    c.loaded = self._cut(mutate.remove(c.loaded, gone.select(keys.doc_id(F.col("ext_id")).alias("doc_id"))))
        for c in self.collections.values():
            self._settle(c, pending)
        result.hits = self._cut(result.hits)
        self.results.append(result.hits)
        self._forget()
        return result

    @staticmethod
    def _coalesced(queue: list[Request]) -> list[Request]:
        """Adjacent requests that can run together, as one, with rows in order."""
        out: list[list[Request]] = []
        for r in queue:
            if out and out[-1][-1].joins(r) and out[-1][-1].rows.schema["data"].dataType == r.rows.schema["data"].dataType:
                out[-1].append(r)
            else:
                out.append([r])
        return [Engine._one(rs) for rs in out]

    @staticmethod
    def _one(requests: list[Request]) -> Request:
        """Several requests as one; rows of each come after those of the one before."""
        first, rows, past = requests[0], requests[0].rows, requests[0].size
        for r in requests[1:]:
            rows = rows.unionByName(r.rows.withColumn("pos", F.col("pos") + past))
            past += r.size
        return Request(first.op, first.index_id, rows, past, first.k, first.nprobe, first.request_id)

    def _encoded(self, queue: list[Request]) -> list[tuple[Request, DataFrame, int]]:
        """Requests with their rows (pos, id, data, metadata, vector), all encoded in one pass for each kind of payload, and how many they are."""
        def kind_of(r: Request) -> str:
            return "ids" if r.op is Op.DELETE_IDS else r.rows.schema["data"].dataType.simpleString()

        by_kind: dict[str, list[DataFrame]] = {}
        for seq, r in enumerate(queue):
            by_kind.setdefault(kind_of(r), []).append(r.rows.select(F.lit(seq).cast("long").alias("seq"), "pos", "id", "data", "metadata"))
        done: dict[str, DataFrame] = {}
        sizes: dict[int, int] = {}
        for kind, parts in by_kind.items():
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            vector = F.lit(None).cast("array<float>")
            if kind.startswith("array") and not self.encoder.takes_vectors:
                vector = F.col("data").cast("array<float>")
            elif kind != "ids":
                vector = F.when(F.col("data").isNotNull(), self.encoder.items(F.col("data")))
            done[kind] = self._cut(rows.withColumn("vector", vector))
            sizes |= {r["seq"]: r["count"] for r in done[kind].groupBy("seq").count().collect()}  # a row for each request
        return [(r, done[kind_of(r)].where(F.col("seq") == seq), sizes.get(seq, 0)) for seq, r in enumerate(queue)]

    def _keyed(self, c: Collection, request: Request, rows: DataFrame) -> DataFrame:
        """Log rows of a mutation, with hashed keys; missing ids of inserts get automatic ones."""
        raw = F.col("id")
        if request.op is Op.INSERT:
            absent, top = rows.agg(F.count_if(keys.missing(raw)), keys.next_id(raw)).first()
            c.next_auto = max(c.next_auto, top)  # automatic ids come after all that were given
            if absent:
                rows = mutate.auto_ids(rows, raw, "pos", c.next_auto, self.auto_id)
                rows, raw = (self._cut(rows) if self.auto_id == "uuid" else rows), F.col("ext_id")
            c.next_auto += absent
        else:
            rows = rows.where(~keys.missing(raw))
        return rows.select("seq", "pos", F.lit(request.op.value).alias("op"), keys.hash_key(raw, self.hash_mode, self.hash_prefix).alias("ext_id"), "vector", "metadata", F.col("data").cast("string").alias("payload"))

    def _settle(self, c: Collection, pending: dict[int, list[DataFrame]]) -> None:
        """Folds what is pending for a collection into it."""
        logs = pending.pop(c.index_id, [])
        if not logs:
            return
        log = logs[0]
        for x in logs[1:]:
            log = log.unionByName(x)
        rows = fold(c.rows, log, self.insert_if_absent)
        rows = STRATEGIES[c.strategy].settle(self, c, rows)
        c.rows = self._cut(rows)
        if c.loaded is not None:
            last = log.groupBy("ext_id").agg(F.max_by("op", F.struct("seq", "pos")).alias("op")).where(F.col("op") == Op.DELETE_IDS.value)
            c.loaded = self._cut(mutate.remove(c.loaded, last.select(keys.doc_id(F.col("ext_id")).alias("doc_id"))))
        for hook in self.hooks:
            hook(c, log)

    def promote(self, handle: int | str) -> None:
        """An extension: the fresh level's rows become settled ones."""
        c = self.resolve(handle)
        rows = c.rows.withColumn("level", F.lit(2))
        if 2 in c.levels:
            rows = topology.place(rows.drop("cluster_id", "level"), c.levels[2], c.metric, 2).select(*c.rows.columns)
        c.rows = self._cut(rows)

    def _hits(self, c: Collection, request: Request, queries: DataFrame) -> DataFrame:
        """HITS rows of one search."""
        rows = c.rows.withColumnRenamed("ext_id", "id")
        found = STRATEGIES[c.strategy].search(c, rows, queries, request.k, request.nprobe or self.nprobe)
        if "distance" not in found.columns:
            found = found.withColumn("distance", F.lit(None).cast("double"))
        named = search.with_payload(found.join(rows.select("id", "metadata", "payload"), "id"))
        return named.select(F.lit(request.request_id).alias("request_id"), F.col("query_id").cast("int").alias("query_idx"), "rank", F.col("id").alias("ext_id"), "score", "distance", "metadata")

    def _cut(self, df: DataFrame) -> DataFrame:
        """Writes rows to the session's shared folder and reads them from there."""
        out = tables.cut_parts(df, "cluster_id") if "cluster_id" in df.columns else tables.cut(df)
        self.written.append(out)
        return out

    def _forget(self) -> None:
        """Deletes the written tables that no collection and no result holds any more."""
        used = {tables.path_of(t) for c in self.collections.values() for t in (c.rows, c.loaded, c.centroids, *c.levels.values())} | {tables.path_of(t) for t in self.results}
        gone = [t for t in self.written if tables.path_of(t) not in used]
        tables.drop(*gone)
        self.written = [t for t in self.written if tables.path_of(t) in used]

    # -- documents, dumps --------------------------------------------------------

    def docs(self, handle: int | str) -> DataFrame:
        """(doc_id, data, metadata) of a collection: loaded documents, and over them its rows' payloads."""
        c = self.resolve(handle)
        own = c.rows.select(keys.doc_id(F.col("ext_id")).alias("doc_id"), F.col("payload").alias("data"), "metadata").dropDuplicates(["doc_id"])
        return mutate.record(c.loaded if c.loaded is not None else tables.local(self.spark, [], DOCS), own)

    def get_doc(self, handle: int | str, doc_id: str) -> dict | None:
        row = self.docs(handle).where(F.col("doc_id") == str(doc_id)).first()
        return None if row is None else {"data": row["data"], "metadata": row["metadata"]}

    def doc_store_size(self, handle: int | str) -> int:
        return self.docs(handle).count()

    def load_docs(self, handle: int | str, path: str) -> None:
        self.resolve(handle).loaded = self._cut(docstore.read(self.spark, path))

    def save_docs(self, handle: int | str, path: str) -> None:
        docstore.write(self.docs(handle), path)

    def dump(self, handle: int | str, path: str) -> None:
        """Writes a collection as an index dump."""
        c = self.resolve(handle)
        if c.centroids is None:
            dumps.write_flat(path, c.rows, c.metric, c.dim)
        else:
            dumps.write(path, c.rows, c.centroids, c.metric, c.dim)

    def restore(self, handle: int | str, path: str) -> None:
        """Replaces a collection by an index dump, whose metric and dim hold from then on."""
        c, d = self.resolve(handle), dumps.read(self.spark, path)
        c.metric, c.dim = d.metric, d.dim
        have = set(d.vectors.columns)
        rows = d.vectors.select("ext_id", "vector", *(F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in (("metadata", "map<string,string>"), ("payload", "string"))), "cluster_id")
        if not STRATEGIES[c.strategy].placed:
            c.rows = self._cut(rows.drop("cluster_id"))
        else:
            c.centroids, c.rows = d.centroids, self._cut(rows.withColumn("level", F.lit(2)))

    def close(self) -> None:
        """Runs what is queued, forgets the collections and deletes all that was written, results too."""
        self.run()
        self.collections.clear()
        self.names.clear()
        self.results.clear()
        self._forget()

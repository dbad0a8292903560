"""Schemas of the engine's tables and its few enums."""

from __future__ import annotations

from enum import Enum


class Metric(str, Enum):
    COSINE = "cosine"
    IP = "ip"
    L2 = "l2"

    @classmethod
    def parse(cls, name: str | Metric) -> Metric:
        """A metric by any of its usual names, in any case."""
        known = {"cosine": cls.COSINE, "cos": cls.COSINE, "ip": cls.IP, "inner": cls.IP, "inner_product": cls.IP, "dot": cls.IP, "l2": cls.L2, "euclidean": cls.L2}
        key = name.value if isinstance(name, Metric) else str(name).strip().lower()
        if key not in known:
            raise ValueError(f"unknown metric: {name}")
        return known[key]


class Op(str, Enum):
    INSERT = "insert"
    UPDATE = "update"
    DELETE_IDS = "delete_ids"
    DELETE_KNN = "delete_knn"
    SEARCH = "search"
    FLUSH = "flush"


CATALOG = "index_id int, name string, dim int, metric string, strategy string, options map<string,string>"
VECTORS = "ext_id string, vector array<float>, metadata map<string,string>, payload string"
PLACED = VECTORS + ", cluster_id int, level int"
CENTROIDS = "cluster_id int, centroid array<float>"
OP_LOG = "seq long, pos int, index_id int, op string, ext_id string, data string, vector array<float>, metadata map<string,string>, k int, nprobe int, request_id string"
HITS = "request_id string, query_idx int, rank int, ext_id string, score double, distance double, metadata map<string,string>"
DOCS = "doc_id string, data string, metadata map<string,string>"
LATENCY = "kind string, seconds double, item_idx long, qps double"

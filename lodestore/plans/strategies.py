"""Strategies: how a collection's rows are placed and searched.

A strategy of one's own is a subclass of Strategy, given to register() under a name
that Engine(strategy=...) then takes.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search, topology

if TYPE_CHECKING:
    from .engine import Collection, Engine


class Strategy(ABC):
    """placed: whether rows have a cluster_id and a level, and the collection a routing table."""

    placed = False

    def settle(self, engine: Engine, c: Collection, rows: DataFrame) -> DataFrame:
        """The collection's rows after a run of mutations, which leaves new rows without a cluster."""
        return rows

    @abstractmethod
    def search(self, c: Collection, rows: DataFrame, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        """(query_id, rank, id, score), and a distance if there is one, of the collection's rows (id, vector, ...)."""


class Exact(Strategy):
    def search(self, c: Collection, rows: DataFrame, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        return search.search(rows, queries, k, c.metric)


class Ivf(Strategy):
    placed = True

    def settle(self, engine: Engine, c: Collection, rows: DataFrame) -> DataFrame:
        old, new = rows.where("cluster_id is not null"), rows.where("cluster_id is null").drop("cluster_id", "level")
        return old.unionByName(topology.place(new, c.centroids, c.metric, 2).select(*old.columns))

    def search(self, c: Collection, rows: DataFrame, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        return search.search_probes(rows, c.centroids, queries, k, nprobe, c.metric)


class Multilevel(Strategy):
    """New rows go to the fresh level, 0, whose clusters grow with them, in order of their ids; level 2 is the settled one."""

    placed = True

    def settle(self, engine: Engine, c: Collection, rows: DataFrame) -> DataFrame:
        rows, o = engine._cut(rows), c.options
        old, new = rows.where("cluster_id is not null"), rows.where("cluster_id is null")
        placed, moved, _ = topology.grow(
            new.drop("cluster_id", "level"), c.centroids, engine._cut(topology.cluster_sizes(old.where("level = 0"))), "ext_id", c.metric,
            float(o.get("new_threshold", np.inf)), float(o.get("merge_threshold", np.inf)), int(o.get("max_clusters", 0)) or max(int(o.get("clusters", 1)), 1), keep=engine._cut,
        )
        c.centroids = engine._cut(moved)
        return old.unionByName(placed.withColumn("level", F.lit(0)).select(*old.columns))

    def search(self, c: Collection, rows: DataFrame, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        threshold = float(c.options.get("search_threshold", -np.inf))
        return search.search_levels(rows.where("level = 0"), rows.where("level = 2"), queries, k, threshold, c.metric, c.levels.get(2), nprobe)


STRATEGIES: dict[str, Strategy] = {"exact": Exact(), "ivf": Ivf(), "multilevel": Multilevel()}


def register(name: str, strategy: Strategy) -> None:
    """Makes a strategy known under a name, in place of one that had it."""
    STRATEGIES[name] = strategy

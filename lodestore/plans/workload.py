"""Workloads: in which order searches and inserts come, and how long each took."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..operators import stats
from ..streaming.ingest import Pace
from ..types import LATENCY
from .engine import Engine

MODES = ("paired", "searches_first", "head_search", "search_only", "insert_only", "search_then_last_insert", "ratio")


@dataclass(frozen=True, eq=False)
class Stored(Sequence):
    """Items (id, data) that stay in a table, in the order of their numbers; a slice is one of the same table."""

    rows: DataFrame  # row, id, data
    at: range

    @classmethod
    def of(cls, rows: DataFrame, order: str) -> Stored:
        """Rows (id, data, and perhaps others), in the order of a column with distinct values."""
        named = stats.numbered(rows, order).select("row", F.col("id").cast("string").alias("id"), "data")
        kept = tables.cut(named.repartitionByRange("row").sortWithinPartitions("row"))
        return cls(kept, range(kept.count()))

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, i: Any) -> Any:
        return Stored(self.rows, self.at[i]) if isinstance(i, slice) else next(iter(Stored(self.rows, range(self.at[i], self.at[i] + 1))))

    def __iter__(self) -> Iterator[tuple[str, Any]]:
        return ((r["id"], r["data"]) for r in self.frame().orderBy("pos").toLocalIterator())

    def frame(self) -> DataFrame:
        """(pos, id, data): these items, with their places in the slice."""
        low, high = sorted((self.at[0], self.at[-1])) if self.at else (0, -1)
        some = self.rows.where(F.col("row").between(low, high)).withColumn("pos", (F.col("row") - self.at.start) / self.at.step)
        return some.where(F.col("pos") == F.floor("pos")).select(F.col("pos").cast("long").alias("pos"), "id", "data")


def batches(items: Sequence[Any], size: int) -> list[Sequence[Any]]:
    """Items in order, `size` at a time."""
    return [items[i : i + size] for i in range(0, len(items), size)]


def schedule(mode: str, inserts: Sequence[int], searches: Sequence[int], ratio: tuple[int, int] = (1, 1)) -> Iterator[tuple[str, int]]:
    """("search" or "insert", number of the batch) in the order of a mode; inserts, searches: the batches' sizes.

    paired: each search before an insert, then what is left.  searches_first: all
    searches, then all inserts.  head_search: one search, then all inserts.
    search_then_last_insert: all searches and at last one insert.  ratio: a search is
    due when, with its batch aside, fewer items were searched than ratio (searches,
    inserts) gives for those inserted.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    n_search = {"head_search": min(1, len(searches)), "insert_only": 0}.get(mode, len(searches))
    n_insert = {"search_only": 0, "search_then_last_insert": min(1, len(inserts))}.get(mode, len(inserts))
    asked = stored = s = i = 0
    while s < n_search or i < n_insert:
        due = {"paired": s <= i, "ratio": asked * ratio[1] < stored * ratio[0]}.get(mode, True)
        if s < n_search and (due or i == n_insert):
            yield "search", s
            asked, s = asked + searches[s], s + 1
        else:
            yield "insert", i
            stored, i = stored + inserts[i], i + 1


def drive(engine: Engine, index: int | str, items: Sequence[Any], queries: Sequence[Any], mode: str, k: int = 5, nprobe: int | None = None, insert_batch: int = 256, search_batch: int = 256, ratio: tuple[int, int] = (1, 1), ops_per_run: int = 1, qps: float = 0.0) -> DataFrame:
    """Replays a workload and gives LATENCY rows, one for each run, under its first operation's kind.

    A run starts after ops_per_run operations; qps paces runs, 0 doesn't.  Items and
    queries that are Stored stay where they are.
    """

    def given(batch: Sequence[Any]) -> Any:
        return batch.frame() if isinstance(batch, Stored) else batch

    held, asked = batches(items, insert_batch), batches(queries, search_batch)
    pace, out, waiting = Pace(qps), [], []
    order = list(schedule(mode, [len(b) for b in held], [len(b) for b in asked], ratio))
    for n, (kind, at) in enumerate(order):
        if kind == "search":
            engine.add_search(index, given(asked[at]), k, f"search-{at}", nprobe)
        else:
            engine.add_insert(index, given(held[at]))
        waiting.append(kind)
        if len(waiting) == ops_per_run or n == len(order) - 1:
            pace.wait()
            began = time.perf_counter()
            engine.run()
            out.append((waiting[0], time.perf_counter() - began, n, float(qps)))
            waiting = []
    return engine.spark.createDataFrame(out, LATENCY)

"""Datasets as requests: where a dataset's split is, and the builder that makes memories of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..functions import text
from ..operators import memories
from .datasets import scan

Builder = Callable[[DataFrame, "int | None"], DataFrame]

# The splits that datasets are read from where none is asked for.
SPLITS = {"chats": "train_sft"}
OTHER_SPLIT = "train"


def _trajectories(rows: DataFrame, limit: int | None) -> DataFrame:
    return memories.trajectories(rows, "__order", memories.first_filled_list(*(F.col(c) for c in ("conversation", "conversations", "messages"))), limit)


def _chats(rows: DataFrame, limit: int | None) -> DataFrame:
    return memories.chats(rows, "__order", F.col("prompt"), F.col("messages"), limit)


def _math_steps(rows: DataFrame, limit: int | None) -> DataFrame:
    return memories.math_steps(rows, "__order", F.col("instruction"), F.col("next_response"), F.col("answer"), limit)


def _tagged_reasoning(rows: DataFrame, limit: int | None) -> DataFrame:
    question = text.first_filled(*(F.col(c) for c in ("question", "prompt", "query", "problem")))
    return memories.tagged_reasoning(rows, "__order", question, F.col("answer"), F.col("generation"), limit)


def _feedback(rows: DataFrame, limit: int | None) -> DataFrame:
    return memories.feedback(rows, "__order", F.col("instruction"), F.col("models"), F.col("completions"), limit)


def _function_calls(rows: DataFrame, limit: int | None) -> DataFrame:
    return memories.function_calls(rows, "__order", F.col("query"), F.col("tools"), F.col("answers"), limit)


BUILDERS: dict[str, Builder] = {
    "trajectories": _trajectories,
    "chats": _chats,
    "math_steps": _math_steps,
    "tagged_reasoning": _tagged_reasoning,
    "feedback": _feedback,
    "function_calls": _function_calls,
}


class Dataset:
    """A split of a dataset, in the folder of its name under a path, as requests.

    build: a builder of one's own, (rows, limit) to requests.  limit: requests, or as
    the builder counts; None and numbers below 1 are no limit.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, split: str | None = None, limit: int | None = None, kind: str | None = None, build: Builder | None = None) -> None:
        if build is None and name not in BUILDERS:
            raise RuntimeError(f"no builder for dataset {name}")
        self.spark, self.name, self.path, self.kind = spark, name, path.rstrip("/"), kind
        self.split = split or SPLITS.get(name, OTHER_SPLIT)
        self.limit = limit if limit is not None and limit > 0 else None
        self.build = build or BUILDERS[name]
        self._data: DataFrame | None = None

    def rows(self) -> DataFrame:
        """The split's rows as they are; a RuntimeError where they can't be read."""
        return scan(self.spark, self.name, f"{self.path}/{self.split}", self.kind)

    def data(self) -> DataFrame:
        """The requests, built once and written to the shared folder."""
        if self._data is None:
            self._data = tables.cut(self.build(self.rows(), self.limit))
        return self._data

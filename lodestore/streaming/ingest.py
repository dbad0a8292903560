"""Asynchronous ingest: a stream of operation-log files, folded batch by batch.

Each micro-batch is appended, folded, under its own number, so a batch that is run
again replaces itself.  Readers fold the appended batches over the last compacted
version; compaction writes a new version when few of the physical rows are live.

    <path>/batches/batch=<n>   folded rows of a micro-batch
    <path>/version=<n>         rows as of batch n
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import assign
from ..operators.topology import COMPACT_RATIO, needs_compaction
from ..plans.fold import VALUES, fold
from ..types import VECTORS, Metric

LOG = "seq long, pos int, op string, ext_id string, vector array<float>, metadata map<string,string>, payload string"


class Ingest:
    """A collection fed by a stream; flush() is the barrier after which everything offered is applied.

    max_files: source files of a micro-batch.  capacity: rows that may wait between
    offer() and the stream, 0 for any number; block: whether an offer to a full
    queue waits or is refused.  With centroids (cluster_id, centroid), each vector is
    sent to the cluster of its nearest one as its batch is applied, and snapshots
    have a cluster_id.
    """

    def __init__(self, spark: SparkSession, source: str, path: str, max_files: int = 64, insert_if_absent: bool = False, capacity: int = 0, block: bool = True, centroids: DataFrame | None = None, metric: Metric | str = Metric.L2) -> None:
        self.spark, self.source, self.path, self.max_files, self.insert_if_absent = spark, source, path, max_files, insert_if_absent
        self.capacity, self.block, self.centroids, self.metric = capacity, block, centroids, Metric.parse(metric)
        routed = centroids is not None
        self.values = (*VALUES, "cluster_id") if routed else VALUES
        self.schema, self.log_schema = (t + ", cluster_id int" if routed else t for t in (VECTORS, LOG))
        self.query: StreamingQuery | None = None
        self.hooks: list[Callable[[DataFrame, int], None]] = []
        self.offered, self.applied, self.stopped = 0, {}, False

    def offer(self, log: DataFrame) -> bool:
        """Appends operations (LOG columns) to the source, and says whether it did.

        A full queue refuses them, or is waited for: by the running stream, and where
        none runs by applying what waits.  After stop() all are refused until the next
        start().
        """
        while self.capacity and not self.stopped and self.waiting() >= self.capacity:
            if not self.block:
                return False
            self.flush()
        if self.stopped:
            return False
        seen = Observation()
        rows = log.observe(seen, F.count(F.lit(1)).alias("rows")) if self.capacity else log
        rows.write.mode("append").parquet(self.source)
        if self.capacity:
            self.offered += seen.get["rows"]
        return True

    def waiting(self) -> int:
        """Rows offered here, with a capacity, that no batch has applied."""
        return max(0, self.offered - sum(self.applied.values()))

    def start(self, once: bool = False, seconds: float = 1.0) -> StreamingQuery:
        """Starts applying; once: what is there now, in batches, and then ends."""
        if self.query is not None and self.query.isActive:
            return self.query
        self.stopped = False
        stream = self.spark.readStream.schema(LOG).option("maxFilesPerTrigger", self.max_files).parquet(self.source)
        writer = stream.writeStream.foreachBatch(self._apply).option("checkpointLocation", f"{self.path}/checkpoint")
        self.query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{int(seconds * 1000)} milliseconds")).start()
        return self.query

    def _apply(self, batch: DataFrame, number: int) -> None:
        # inserts and deletes need no more than their last; an update also needs what came before it
        at = F.struct("seq", "pos")
        last = F.max(F.when(F.col("op").isin("insert", "delete_ids"), at))
        kept = batch.join(batch.groupBy("ext_id").agg(last.alias("last")), "ext_id").where(F.col("last").isNull() | (at >= F.col("last"))).select(*batch.columns)
        if self.centroids is not None:
            kept = assign(kept, self.centroids, self.metric)
        kept.write.mode("overwrite").parquet(f"{self.path}/batches/batch={number}")
        if self.capacity:
            self.applied[number] = batch.count()
        for hook in self.hooks:
            hook(batch, number)

    def flush(self) -> None:
        """Waits until all that was offered is applied."""
        if self.query is None or not self.query.isActive:
            self.start(once=True)
            self.query.awaitTermination()
            if self.query.exception():
                raise self.query.exception()
        else:
            self.query.processAllAvailable()

    def stop(self) -> None:
        """Stops; what wasn't applied stays in the source for the next start."""
        self.stopped = True
        if self.query is not None:
            self.query.stop()

    def _numbers(self, kind: str, folder: str) -> list[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith(f"{kind}=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _parts(self) -> tuple[DataFrame, DataFrame, int]:
        """The last version, the batches after it, and the number of the last batch."""
        versions, batches = self._numbers("version", self.path), self._numbers("batch", f"{self.path}/batches")
        base = self.spark.read.schema(self.schema).parquet(f"{self.path}/version={versions[-1]}") if versions else self.spark.createDataFrame([], self.schema)
        new = [b for b in batches if not versions or b > versions[-1]]
        log = self.spark.read.schema(self.log_schema).parquet(*(f"{self.path}/batches/batch={b}" for b in new)) if new else self.spark.createDataFrame([], self.log_schema)
        return base, log, batches[-1] if batches else -1

    def _folded(self, base: DataFrame, log: DataFrame) -> DataFrame:
        return fold(base.select("ext_id", *self.values), log, self.insert_if_absent, self.values)

    def snapshot(self) -> DataFrame:
        """The collection (ext_id, vector, metadata, payload) as of the last applied batch."""
        base, log, _ = self._parts()
        return self._folded(base, log)

    def compact(self, ratio: float = COMPACT_RATIO) -> bool:
        """Writes a new version if fewer than `ratio` of the physical rows are live; says whether it did."""
        base, log, last = self._parts()
        # batches that end meanwhile are left to the next version
        physical, live = base.count() + log.count(), self._folded(base, log).count()
        if last < 0 or not needs_compaction(live, physical, ratio):
            return False
        self._folded(base, log).write.mode("overwrite").parquet(f"{self.path}/version={last}")
        return True


class Pace:
    """An open-loop gate: wait() returns at most `qps` times a second, without catching up."""

    def __init__(self, qps: float) -> None:
        self.gap, self.due = 1 / qps if qps > 0 else 0.0, 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if self.due > now:
            time.sleep(self.due - now)
        self.due = max(now, self.due) + self.gap

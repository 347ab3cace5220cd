"""Continuous forms of the batch jobs.

Stateful results are kept as tables written per micro-batch under
``batch=<id>``. A replayed micro-batch overwrites its own folder and reads only
earlier ones. Checkpoint and tables live below the feed's ``home``: a job that is
started again on the same home goes on after its last finished micro-batch, so
every job is exactly-once after a failure. Without a home a new one is made up,
which suits a single run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figureyard.operators import batching, delivery
from figureyard.operators.ranking import latest_per_key
from figureyard.operators.reports import side_by_side
from figureyard.session import materialised, shared_path
from figureyard.streaming import keyed
from figureyard.streaming.snapshots import Snapshot

BACKLOG_PAGES = 3000  # fixed value: waiting pages above which intake pauses


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet",
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


@dataclass
class Feed:
    """A stream and what happens before each run over it. A service runs once,
    continuously; a scheduled job runs once per arrival of new files, resuming
    from the same checkpoint."""

    stream: DataFrame
    arrivals: Sequence[Callable[[], None]] = (lambda: None,)
    home: str | None = None

    def __post_init__(self) -> None:
        self.home = self.home or shared_path(self.spark, "stream")

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Feed:
        return Feed(change(self.stream), self.arrivals, self.home)

    def table(self, name: str, schema: str) -> BatchTable:
        return BatchTable(self.spark, name, schema, self.home)

    @property
    def spark(self) -> SparkSession:
        return self.stream.sparkSession


def drain(feed: Feed, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything available after each arrival."""
    checkpoint = f"{feed.home}/checkpoint"
    for arrive in feed.arrivals:
        arrive()
        query = (
            feed.stream.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(sink)
            .start()
        )
        query.awaitTermination()


class BatchTable:
    """A table of micro-batch results with one folder per batch id."""

    def __init__(self, spark: SparkSession, name: str, schema: str, home: str | None = None):
        self.spark, self.schema = spark, schema
        self.path = f"{home}/{name}" if home else shared_path(spark, name)

    def put(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def rows(self, before: int | None = None) -> DataFrame:
        """All rows, or only those of batches before ``before``."""
        try:
            df = self.spark.read.schema(f"{self.schema}, batch INT").parquet(self.path)
        except Exception as exc:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            df = self.spark.createDataFrame([], f"{self.schema}, batch INT")
        return df if before is None else df.filter(F.col("batch") < before)

    def batch(self, batch_id: int) -> DataFrame:
        """Rows of one micro-batch that was put."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch_id}")

    def latest(self, keys: Sequence[str], before: int | None = None) -> DataFrame:
        return latest_per_key(self.rows(before), keys, F.col("batch"))


def register_stream(feed: Feed, arrival: str, schema: str) -> BatchTable:
    """First arrival per version-less id over all batches, without a time bound:
    which ids are known is keyed state, so the registry is never read again."""
    table = feed.table("registry", schema)
    with keyed.on_rocksdb(feed.spark):
        drain(feed.map(lambda rows: keyed.first_arrivals(rows, "base_id", arrival)), table.put, "update")
    return table


def dedup_within_watermark(stream: DataFrame, ts: str, key: str, delay: str) -> DataFrame:
    """Bounded-state form: copies that arrive within ``delay`` are dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def entity_states(feed: Feed, key: str) -> BatchTable:
    """Current status, total cost and attempts per entity, kept in JVM state."""
    schema = f"{key} BIGINT, status STRING, cost DOUBLE, failures BIGINT, steps BIGINT"
    table = feed.table("entity-states", schema)
    columns = [
        F.max_by("status", "seq").alias("status"), F.sum("cost").alias("cost"),
        F.count_if(F.col("status") == "failed").alias("failures"), F.count(F.lit(1)).alias("steps"),
    ]
    drain(feed.map(lambda log: log.groupBy(key).agg(*columns)), table.put, mode="update")
    return table


def live_counters(feed: Feed, keys: Sequence[str], schema: str) -> BatchTable:
    table = feed.table("live-counters", schema)
    n = F.count(F.lit(1)).alias("n")
    drain(feed.map(lambda log: log.groupBy(*keys).agg(n)), table.put, mode="update")
    return table


def throughput_windows(feed: Feed, ts: str, width: str, delay: str) -> BatchTable:
    """Finished items per tumbling window; the watermark bounds the state."""
    table = feed.table("throughput", "start TIMESTAMP, n BIGINT, done BIGINT")

    def windows(log: DataFrame) -> DataFrame:
        return (
            log.withWatermark(ts, delay)
            .groupBy(F.window(ts, width).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "labeled").alias("done"))
            .select(F.col("w.start").alias("start"), "n", "done")
        )

    drain(feed.map(windows), table.put, mode="update")
    return table


def intake_control(feed: Feed, target: int, backlog: int = BACKLOG_PAGES) -> BatchTable:
    """Per micro-batch: totals so far and whether intake runs, pauses or stops."""
    schema = "done BIGINT, waiting BIGINT, action STRING"
    table = feed.table("intake", schema)

    def sink(batch: DataFrame, batch_id: int) -> None:
        last = table.rows(before=batch_id).agg(F.max_by(F.struct("done", "waiting"), "batch").alias("s"))
        now = batch.agg(
            F.count_if(F.col("status") == "labeled").alias("d"),
            F.count_if(F.col("status") == "pending").alias("w"),
        )
        before = last.select(
            F.coalesce("s.done", F.lit(0)).alias("d0"), F.coalesce("s.waiting", F.lit(0)).alias("w0")
        )
        sums = side_by_side([now, before]).select(
            (F.col("d0") + F.col("d")).alias("done"), (F.col("w0") + F.col("w")).alias("waiting")
        )
        action = F.when(F.col("done") >= target, "stop").when(F.col("waiting") > backlog, "pause")
        table.put(sums.withColumn("action", action.otherwise("run")), batch_id)

    drain(feed, sink)
    return table


def run_until(feed: Feed, target: int, poll: float = 1.0) -> int:
    """Copy the feed to the table ``log`` continuously and stop the query once
    ``target`` items are labeled. Counts are kept for each micro-batch, so a
    restart goes on counting and a replay does not count twice. Returns how many
    were seen on this home."""
    log = feed.table("log", feed.stream.schema.simpleString()[7:-1].replace(":", " "))
    counts = feed.table("labeled", "n BIGINT")

    def sink(batch: DataFrame, batch_id: int) -> None:
        log.put(batch, batch_id)
        written = log.rows().filter(F.col("batch") == batch_id)
        counts.put(written.agg(F.count_if(F.col("status") == "labeled").alias("n")), batch_id)

    def done() -> int:
        return counts.rows().agg(F.sum("n").alias("n")).first()["n"] or 0

    for arrive in feed.arrivals:
        arrive()
    query = (
        feed.stream.writeStream.option("checkpointLocation", f"{feed.home}/checkpoint")
        .foreachBatch(sink).start()
    )
    while query.isActive and done() < target:
        query.awaitTermination(timeout=poll)
    query.stop()
    return done()


def refreshed_snapshot(feed: Feed, schema: str, key: str) -> Snapshot:
    """Publish the latest row of each key, once per batch; a batch writes its
    changes only. A service triggers this every few minutes."""
    out = Snapshot(feed.spark, f"{feed.home}/snapshot", [key], schema)

    def sink(batch: DataFrame, batch_id: int) -> None:
        out.put(batch.dropDuplicates([key]), batch_id)

    drain(feed, sink)
    return out


def archive_stream(feed: Feed, group: str, key: str, size: str, bucket: Column, cap: int,
                   schema: str, state_schema: str) -> BatchTable:
    """Number archives as items arrive; the open archive of every group is
    carried from batch to batch."""
    table = feed.table("archives", schema)
    states = feed.table("archive-states", state_schema)

    def sink(batch: DataFrame, batch_id: int) -> None:
        before = states.latest([group], before=batch_id).select(group, "closed", "carry")
        numbered, state = batching.size_capped_batches(batch, group, key, size, bucket, cap, before)
        table.put(numbered.withColumnRenamed("batch", "archive_no"), batch_id)
        states.put(state, batch_id)

    drain(feed, sink)
    return table


def delivery_stream(feed: Feed, manifest: DataFrame, chunk: int = delivery.CHUNK) -> BatchTable:
    """Every batch delivers the next items of ``manifest`` (numbered by ``pos``
    from 1) to the users that asked in it; how far a user has come is keyed state.
    The manifest is numbered once for a run, not again in every micro-batch."""
    table = feed.table("deliveries", "uid BIGINT, image_id BIGINT")
    asked = feed.table("ranges", "uid BIGINT, low BIGINT, high BIGINT")
    cells = materialised(delivery.in_cells(manifest, chunk), "manifest-cells")
    total = cells.agg(F.coalesce(F.max("last"), F.lit(0)).alias("n")).first()["n"]

    def sink(ranges: DataFrame, batch_id: int) -> None:
        asked.put(ranges, batch_id)  # read more than once, while state steps on once
        table.put(delivery.at_ranges(asked.batch(batch_id), cells, chunk), batch_id)

    with keyed.on_rocksdb(feed.spark):
        drain(feed.map(lambda rows: keyed.next_ranges(rows, "uid", chunk, total)), sink)
    return table

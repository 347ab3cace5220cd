"""Intake that pauses when too much waits, and ends at the target.

Two streams share a queue whose rows are numbered by ``pos`` (0, 1, ...). Intake
admits the next positions, the worker takes admitted ones in order. Both read a
streaming source that hands out positions up to an offset; before each trigger the
offset is set from what the other stream has finished, so intake cannot pass the
worker by more than ``backlog`` and the worker cannot pass intake. A stream whose
offset may not move starts no micro-batch: it is paused. Plans of a turn are
written before it moves, so a turn that died is repeated as planned. Once the worker has
finished ``target`` successes, neither is triggered again.

Offsets lie in the streams' checkpoints, results in tables by micro-batch, and
the next offsets follow from those tables: a job that died goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from figureyard.streaming.jobs import BatchTable

RANGES = 16  # partitions of a micro-batch


class Positions(DataSource):
    """Ranges (low, high) of positions from where the stream stands up to ``upto``."""

    @classmethod
    def name(cls) -> str:
        return "positions"

    def schema(self) -> str:
        return "low LONG, high LONG"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return PositionsReader(int(self.options["upto"]))


class PositionsReader(DataSourceStreamReader):
    def __init__(self, upto: int):
        self.upto = upto

    def initialOffset(self) -> dict:  # noqa: N802
        return {"pos": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"pos": self.upto}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, n = start["pos"], end["pos"] - start["pos"]
        cuts = [a + n * i // RANGES for i in range(RANGES + 1)]
        return [InputPartition((x, y)) for x, y in zip(cuts, cuts[1:]) if x < y]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, int]]:
        yield partition.value


class Governed:
    """A stream over positions that moves only as far as it is told."""

    def __init__(self, spark: SparkSession, home: str, name: str, queue: DataFrame, schema: str,
                 work: Callable[[DataFrame], DataFrame]):
        spark.dataSource.register(Positions)
        self.spark, self.queue, self.work = spark, queue, work
        self.checkpoint = f"{home}/{name}-checkpoint"
        self.table = BatchTable(spark, name, schema, home)
        self.moves = BatchTable(spark, f"{name}-moves", "low LONG, high LONG, successes LONG", home)

    def at(self) -> tuple[int, int]:
        """(positions finished, successes among them)."""
        r = self.moves.rows().agg(F.max("high").alias("h"), F.sum("successes").alias("s")).first()
        return r["h"] or 0, r["s"] or 0

    def sink(self, ranges: DataFrame, batch_id: int) -> None:
        r = ranges.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
        if r["low"] is None:
            return
        taken = self.queue.filter((F.col("pos") >= r["low"]) & (F.col("pos") < r["high"]))
        self.table.put(self.work(taken), batch_id)
        done = self.table.rows().filter(F.col("batch") == batch_id)
        success = F.count_if("success") if "success" in done.columns else F.lit(0).cast("long")
        self.moves.put(
            done.agg(success.alias("successes")).select(
                F.lit(r["low"]).cast("long").alias("low"), F.lit(r["high"]).cast("long").alias("high"), "successes"
            ),
            batch_id,
        )

    def move(self, upto: int) -> bool:
        """One micro-batch up to position ``upto``; False if that is no move."""
        if upto <= self.at()[0]:
            return False
        query = (
            self.spark.readStream.format("positions").option("upto", upto).load().writeStream
            .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).foreachBatch(self.sink).start()
        )
        query.awaitTermination()
        return True


def governed_intake(
    queue: DataFrame, home: str, work: Callable[[DataFrame], DataFrame], schema: str, target: int,
    admit: int, capacity: int, backlog: int, cycles: int | None = None,
) -> DataFrame:
    """Run intake (``admit`` positions a trigger) and ``work`` (``capacity`` a
    trigger; its rows have ``schema`` with a boolean ``success``) by turns until
    ``target`` successes or the end of the queue, or for ``cycles`` turns more.
    Intake pauses while what it admits next would make more than ``backlog`` wait.

    Returns a row for each turn so far: cycle, action of intake (run, pause, or end
    when all is admitted), admitted, done, waiting, successes. The queue is read by ranges of ``pos``.
    """
    spark = queue.sparkSession
    total = queue.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("n")).first()["n"]
    intake = Governed(spark, home, "admitted", queue, "pos LONG", lambda rows: rows.select("pos"))
    worker = Governed(spark, home, "worked", queue, schema, work)
    plans = BatchTable(spark, "plans", "cycle LONG, action STRING, admit_to LONG, work_to LONG", home)
    log = BatchTable(spark, "cycles", "cycle LONG, action STRING, admitted LONG, done LONG, waiting LONG, successes LONG", home)
    first = log.rows().agg(F.max("cycle").alias("c")).first()["c"]
    cycle = 0 if first is None else first + 1
    stop_at = None if cycles is None else cycle + cycles
    while stop_at is None or cycle < stop_at:
        (done, successes), admitted = worker.at(), intake.at()[0]
        plan = plans.rows().filter(F.col("batch") == cycle).first()  # of a turn that died
        if plan is None:
            if successes >= target or done >= total:
                break
            upto = min(total, admitted + admit)
            if admitted >= total:
                action = "end"
            elif upto - done > backlog:
                action, upto = "pause", admitted
            else:
                action = "run"
            row = [(cycle, action, upto, min(done + capacity, upto))]
            plans.put(spark.createDataFrame(row, plans.schema), cycle)
            plan = plans.rows().filter(F.col("batch") == cycle).first()
        intake.move(plan["admit_to"])
        worker.move(plan["work_to"])
        done, successes = worker.at()
        row = [(cycle, plan["action"], plan["admit_to"], done, plan["admit_to"] - done, successes)]
        log.put(spark.createDataFrame(row, log.schema), cycle)
        cycle += 1
    return log.rows().drop("batch")

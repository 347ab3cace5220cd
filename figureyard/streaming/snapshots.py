"""A table that is published in versions: runs of changes, merged on reading.

Every micro-batch writes the latest row of each of its keys as one run and a
commit that lists the runs of its version, oldest first. Readers take the runs of
one commit and keep the row of the newest run for each key, so they always see a
whole version. Runs are compacted like a counter: the newest takes in the one before it
while that is less than twice as long, so a row is rewritten O(log n) times in all, and
a version has O(log n) runs. Runs that no kept version lists are removed.

A replayed micro-batch starts from the version before its own and writes the same
runs and the same commit again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figureyard.operators.ranking import latest_per_key

KEPT = 3  # versions that readers may still hold


@dataclass(frozen=True)
class Run:
    first: int  # versions whose changes it holds
    last: int
    rows: int


class Snapshot:
    """``key`` names the columns that identify a row; a deletion is a row that the
    reader's own filter drops (say by status)."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema

    def commits(self) -> dict[int, list[Run]]:
        try:
            rows = self.spark.read.schema("value STRING, version INT").text(f"{self.path}/commits").collect()
        except AnalysisException as exc:  # nothing committed yet
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        # one short line for each kept version
        return {r["version"]: [Run(**x) for x in json.loads(r["value"])] for r in rows}

    def folder(self, run: Run) -> str:
        return f"{self.path}/runs/{run.first}-{run.last}"

    def read(self, runs: list[Run]) -> DataFrame:
        """Latest row of each key; a run's versions never overlap another's."""
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(self.folder(r)) for r in runs]
        if len(parts) == 1:
            return parts[0]
        both = parts[0].withColumn("__run", F.lit(runs[0].first))
        for p, r in zip(parts[1:], runs[1:]):
            both = both.unionByName(p.withColumn("__run", F.lit(r.first)))
        return latest_per_key(both, self.key, F.col("__run")).drop("__run")

    def write(self, rows: DataFrame, first: int, last: int) -> Run:
        folder = self.folder(Run(first, last, 0))
        rows.write.mode("overwrite").parquet(folder)
        return Run(first, last, self.spark.read.schema(self.schema).parquet(folder).count())

    def put(self, changes: DataFrame, version: int) -> None:
        """Publish ``changes`` (one row for each key) as ``version``, above all others."""
        known = self.commits()
        earlier = [v for v in known if v < version]
        runs = list(known[max(earlier)]) if earlier else []
        new = self.write(changes, version, version)
        tail, rows = [new], new.rows
        while runs and runs[-1].rows < 2 * rows:
            tail.insert(0, runs.pop())
            rows += tail[0].rows
        runs.append(self.write(self.read(tail), tail[0].first, version) if len(tail) > 1 else new)
        text = json.dumps([r.__dict__ for r in runs])
        line = self.spark.createDataFrame([(text,)], "value STRING")
        line.coalesce(1).write.mode("overwrite").text(f"{self.path}/commits/version={version}")
        if len(tail) > 1:
            self.remove(self.folder(new))
        self.clean(known | {version: runs}, version)

    def clean(self, commits: dict[int, list[Run]], version: int) -> None:
        """Forget what none of the last ``KEPT`` versions lists."""
        versions = sorted(v for v in commits if v <= version)
        kept, old = versions[-KEPT:], versions[:-KEPT]
        needed = {self.folder(r) for v in kept for r in commits[v]}
        for folder in {self.folder(r) for v in old for r in commits[v]} - needed:
            self.remove(folder)
        for v in old:
            self.remove(f"{self.path}/commits/version={v}")

    def remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def versions(self) -> list[int]:
        return sorted(self.commits())

    def rows(self, version: int | None = None) -> DataFrame:
        """The newest version, or an older one that is still kept."""
        commits = self.commits()
        if not commits:
            return self.read([])
        return self.read(commits[max(commits) if version is None else version])

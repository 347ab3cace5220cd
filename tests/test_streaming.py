import pytest
from pyspark.sql import functions as F

from figureyard.operators import delivery
from figureyard.plans import streams
from figureyard.session import shared_path
from figureyard.streaming import intake, jobs
from figureyard.streaming.snapshots import Snapshot

FOLDER = "/root/testdata/sf0.001"


def test_registration_over_batches_keeps_first_arrivals(spark):
    rows = [("1", 5), ("2", 1), ("1", 0), ("3", 8), ("2", 7)]
    df = spark.createDataFrame(rows, "base_id string, at long")
    table = jobs.register_stream(streams._arriving(spark, df, "at"), "at", "base_id STRING, at BIGINT")
    assert {(r.base_id, r.at) for r in table.rows().collect()} == {("1", 0), ("2", 1), ("3", 8)}
    assert table.rows().select("batch").distinct().count() > 1


def test_a_replayed_batch_changes_nothing(spark):
    table = jobs.BatchTable(spark, "replay", "k BIGINT")
    table.put(spark.range(3).withColumnRenamed("id", "k"), 0)
    for _ in range(2):
        known = table.rows(before=1)
        new = spark.range(5).withColumnRenamed("id", "k").join(known, "k", "left_anti")
        table.put(new.select("k"), 1)
    assert sorted(r.k for r in table.rows().collect()) == [0, 1, 2, 3, 4]


def test_copies_within_the_watermark_are_dropped(spark):
    path = shared_path(spark, "dedup")
    df = spark.sql("SELECT * FROM VALUES ('a', 1), ('a', 2), ('b', 3) AS t(base_id, s)")
    df.select("base_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(path)
    stream = jobs.file_stream(spark, path, "base_id STRING, ts TIMESTAMP")
    seen = jobs.BatchTable(spark, "deduped", "base_id STRING, ts TIMESTAMP")
    jobs.drain(jobs.Feed(jobs.dedup_within_watermark(stream, "ts", "base_id", "1 hour")), seen.put)
    assert sorted(r.base_id for r in seen.rows().collect()) == ["a", "b"]


def test_intake_pauses_and_stops(spark):
    rows = [(i, "pending" if i < 6 else "labeled") for i in range(12)]
    log = spark.createDataFrame(rows, "seq long, status string")
    out = jobs.intake_control(streams._arriving(spark, log, "seq"), target=5, backlog=4).rows().orderBy("batch")
    assert [(r.done, r.waiting, r.action) for r in out.collect()] == [
        (0, 4, "run"), (2, 6, "pause"), (6, 6, "stop")]


def test_query_stops_once_the_target_is_reached(spark):
    rows = [(i, "labeled") for i in range(9)]
    log = spark.createDataFrame(rows, "seq long, status string")
    feed = streams._arriving(spark, log, "seq")
    assert jobs.run_until(feed, 6) >= 6
    # a new query on the same home neither forgets nor counts twice
    again = jobs.Feed(feed.stream, (), feed.home)
    assert jobs.run_until(again, 9) == 9


RESUMED = {
    "register": lambda feed: jobs.register_stream(feed, "at", "base_id STRING, at BIGINT"),
    "states": lambda feed: jobs.entity_states(
        feed.map(lambda s: s.selectExpr(
            "cast(base_id AS BIGINT) AS entity", "'done' AS status", "at AS seq", "cast(1 AS DOUBLE) AS cost")),
        "entity"),
    "archives": lambda feed: jobs.archive_stream(
        feed.map(lambda s: s.selectExpr("'g' AS field", "at AS image_id", "cast(10 AS BIGINT) AS file_bytes")),
        "field", "image_id", "file_bytes", F.floor(F.col("image_id") / 4), 35,
        "field STRING, image_id BIGINT, archive_no BIGINT", "field STRING, closed BIGINT, carry DOUBLE"),
}


@pytest.mark.parametrize("job", sorted(RESUMED))
def test_a_job_goes_on_where_it_stopped(spark, job):
    rows = [(str(i % 4), i) for i in range(12)]
    df = spark.createDataFrame(rows, "base_id string, at long")

    def result(table):
        df = table.latest(["entity"]) if job == "states" else table.rows()
        return sorted(map(str, df.drop("batch").collect()))

    whole = result(RESUMED[job](streams._arriving(spark, df, "at")))
    parts = streams._arriving(spark, df, "at")
    RESUMED[job](jobs.Feed(parts.stream, parts.arrivals[:1], parts.home))
    resumed = RESUMED[job](jobs.Feed(parts.stream, parts.arrivals[1:], parts.home))
    assert result(resumed) == whole and len(whole) > 2


def test_no_user_gets_an_item_twice(spark):
    out = streams.delivery_stream(spark, FOLDER)
    assert out.groupBy("uid", "image_id").count().filter("count > 1").isEmpty()
    per = out.groupBy("uid", "batch").count().collect()
    assert max(r["count"] for r in per) == delivery.CHUNK


def _stop_after(feed, n):
    return jobs.Feed(feed.stream, feed.arrivals[:n], feed.home), jobs.Feed(feed.stream, feed.arrivals[n:], feed.home)


def test_keyed_jobs_never_read_their_history(spark, monkeypatch):
    def forbidden(self, before=None):
        raise AssertionError("history was read")

    rows = [(str(i % 4), i) for i in range(12)]
    df = spark.createDataFrame(rows, "base_id string, at long")
    asked = spark.createDataFrame([(i % 3, i) for i in range(9)], "uid long, at long")
    manifest = spark.range(1, 8).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("image_id"))
    feeds = streams._arriving(spark, df, "at"), streams._arriving(spark, asked, "at")
    with monkeypatch.context() as m:
        m.setattr(jobs.BatchTable, "rows", forbidden)
        registry = jobs.register_stream(feeds[0], "at", "base_id STRING, at BIGINT")
        given = jobs.delivery_stream(feeds[1], manifest, 3)
    assert sorted((r.base_id, r.at) for r in registry.rows().collect()) == [("0", 0), ("1", 1), ("2", 2), ("3", 3)]
    out = given.rows().collect()
    assert len(out) == 3 * 7 and len({(r.uid, r.image_id) for r in out}) == 21
    assert {r.image_id for r in out if r.batch == 2} == {70}


def test_delivery_goes_on_after_a_restart_and_a_replay(spark):
    asked = spark.createDataFrame([(i % 2, i) for i in range(6)], "uid long, at long")
    manifest = spark.range(1, 31).select(F.col("id").alias("pos"), F.col("id").alias("image_id"))
    first, rest = _stop_after(streams._arriving(spark, asked, "at"), 2)
    table = jobs.delivery_stream(first, manifest, 4)
    # the last micro-batch is not committed: it runs again on restart
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{first.home}/checkpoint/commits/1")
    assert commits.getFileSystem(spark._jsc.hadoopConfiguration()).delete(commits, False)
    before = sorted(map(str, table.rows().collect()))
    jobs.delivery_stream(rest, manifest, 4)
    after = table.rows().collect()
    assert set(before) <= set(map(str, after))
    assert sorted(r.image_id for r in after if r.uid == 0) == list(range(1, 13))


def test_a_delivery_goes_over_cells_of_a_manifest_that_grows(spark, monkeypatch):
    def forbidden(*args):
        raise AssertionError("users travelled as positions")

    asked = spark.createDataFrame([(i % 2, i) for i in range(12)], "uid long, at long")
    short, longer = (
        spark.range(1, n + 1).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("image_id")) for n in (5, 11)
    )
    first, rest = _stop_after(streams._arriving(spark, asked, "at"), 2)
    with monkeypatch.context() as m:
        m.setattr(delivery, "at_positions", forbidden)
        jobs.delivery_stream(first, short, 4)
        out = jobs.delivery_stream(rest, longer, 4).rows().collect()
    per = {b: sorted(r.image_id for r in out if (r.uid, r.batch) == (1, b)) for b in range(3)}
    # the second one ends amid a cell, so the third lies in two
    assert per == {0: [10, 20, 30, 40], 1: [50], 2: [60, 70, 80, 90]} and len(out) == 18


def test_a_cell_that_all_want_comes_out_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(delivery, "TASK_ITEMS", 500)
    manifest = spark.range(1, 30).select(F.col("id").alias("pos"), F.col("id").alias("image_id"))
    ranges = spark.range(400).select(F.col("id").alias("uid"), F.lit(3).cast("long").alias("low"), F.lit(13).cast("long").alias("high"))
    parts = delivery.at_ranges(ranges, delivery.in_cells(manifest, 10), 10).rdd.glom().collect()
    rows = [(r.uid, r.image_id) for part in parts for r in part]
    assert sorted(rows) == [(u, i) for u in range(400) for i in range(4, 14)]
    assert len(parts) == 8 and max(map(len, parts)) < len(rows) / 3


def test_null_and_hot_keys_register_once(spark):
    rows = [(None, 5), (None, 3), *[("hot", i) for i in range(6, 500)], (None, 600), ("cold", 700)]
    df = spark.createDataFrame(rows, "base_id string, at long")
    table = jobs.register_stream(streams._arriving(spark, df, "at"), "at", "base_id STRING, at BIGINT")
    assert {(r.base_id, r.at) for r in table.rows().collect()} == {(None, 3), ("hot", 6), ("cold", 700)}


def test_snapshot_versions(spark):
    s = Snapshot(spark, shared_path(spark, "snapshot"), ["k"], "k BIGINT, v BIGINT")
    assert s.rows().collect() == [] and s.versions() == []
    truth, history = {}, {}
    for version in range(12):
        changes = {(version * 7 + i) % 30: version for i in range(5)}
        truth |= changes
        history[version] = dict(truth)
        s.put(spark.createDataFrame(list(changes.items()), s.schema), version)
        if version == 7:  # a replay publishes the same again
            s.put(spark.createDataFrame(list(changes.items()), s.schema), version)
        assert len(s.commits()[version]) <= 6
    assert s.versions() == [9, 10, 11]
    for version in s.versions():
        assert {r.k: r.v for r in s.rows(version).collect()} == history[version]
    # runs that no version lists are gone
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{s.path}/runs")
    there = {f.getPath().getName() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)}
    assert there == {f"{r.first}-{r.last}" for runs in s.commits().values() for r in runs}


def test_snapshot_writes_stay_small(spark, monkeypatch):
    s = Snapshot(spark, shared_path(spark, "snapshot"), ["k"], "k BIGINT, v BIGINT")
    s.put(spark.range(10_000).selectExpr("id AS k", "id AS v"), 0)
    for version in range(1, 6):
        s.put(spark.range(10).selectExpr("id AS k", f"{version} AS v"), version)
        assert max(r.rows for r in s.commits()[version][1:]) <= 100
        assert s.commits()[version][0].last == 0  # the base stays as it is
    assert s.rows().agg(F.sum("v")).first()[0] == sum(range(10, 10_000)) + 50


def _queue(spark, n):
    return spark.range(n).select(F.col("id").alias("pos"), (F.col("id") % 3 == 0).alias("good"))


def _worked(rows):
    return rows.select("pos", F.col("good").alias("success"))


def test_intake_pauses_and_ends(spark):
    out = intake.governed_intake(
        _queue(spark, 100), shared_path(spark, "intake"), _worked, "pos LONG, success BOOLEAN",
        target=15, admit=20, capacity=7, backlog=30,
    ).orderBy("cycle").collect()
    assert [r.action for r in out] == ["run", "pause", "run", "pause", "pause", "run", "pause"]
    assert max(r.waiting for r in out) <= 30 and all(r.done <= r.admitted for r in out)
    assert out[-1].successes >= 15 > out[-2].successes and out[-1].done == 49


def test_intake_that_died_in_a_turn_goes_on_as_planned(spark, monkeypatch):
    options = dict(target=40, admit=20, capacity=15, backlog=30)
    schema = "pos LONG, success BOOLEAN"
    whole = intake.governed_intake(_queue(spark, 90), shared_path(spark, "intake"), _worked, schema, **options)
    home, queue = shared_path(spark, "intake"), _queue(spark, 90)
    intake.governed_intake(queue, home, _worked, schema, cycles=2, **options)

    def dies(rows):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        intake.governed_intake(queue, home, dies, schema, **options)
    again = intake.governed_intake(queue, home, _worked, schema, **options)
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))
    worked = jobs.BatchTable(spark, "worked", schema, home).rows().collect()
    assert sorted(r.pos for r in worked) == list(range(90))


def test_intake_of_an_empty_queue(spark):
    out = intake.governed_intake(
        _queue(spark, 0), shared_path(spark, "intake"), _worked, "pos LONG, success BOOLEAN",
        target=1, admit=1, capacity=1, backlog=1,
    )
    assert out.collect() == []

"""Incremental delivery of a manifest to users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figureyard.operators.ranking import id_bucket, rank_within

CHUNK = 200  # fixed value: items per delivery
TASK_ITEMS = 1 << 19  # delivered rows that one task is left with
SHARES = 8  # how finely the askers of a task are dealt


def pending_items(manifest: DataFrame, users: DataFrame, delivered: DataFrame,
                  chunk: int = CHUNK) -> DataFrame:
    """The next ``chunk`` undelivered items per user in manifest order.

    ``manifest`` carries its position as ``pos``. The k-th delivered position
    minus k is the number of gaps before it, so runs of delivered items collapse
    to one row each and at most ``chunk`` runs per user matter. The m-th gap then
    follows by arithmetic; nobody is paired with the whole manifest.
    """
    seen = delivered.join(manifest.select("image_id", "pos"), "image_id").select("uid", "pos")
    ranked = rank_within(
        seen, ["uid"], [F.col("pos")], [id_bucket(F.col("pos"))], name="k"
    )
    runs = (
        ranked.withColumn("gaps", F.col("pos") - F.col("k"))
        .filter(F.col("gaps") < chunk)
        .groupBy("uid", "gaps")
        .agg(F.max("k").alias("upto"))
        .groupBy("uid")
        .agg(F.collect_list(F.struct("gaps", "upto")).alias("runs"))
    )
    m = F.col("m")
    passed = F.array_max(
        F.transform(F.filter("runs", lambda r: r["gaps"] <= m), lambda r: r["upto"])
    )
    gaps = (
        users.select("uid").distinct().join(runs, "uid", "left")
        .withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(chunk - 1))))
        .select("uid", (m + 1 + F.coalesce(passed, F.lit(0))).alias("pos"), (m + 1).alias("rn"))
    )
    return at_positions(gaps, manifest)


def at_positions(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of ``wanted`` with the item at their ``pos``. Spark estimates exploded
    positions at the size of what they come from, and would send all of them to
    the driver for a broadcast; the hint makes it hash the manifest's part of a
    shuffle instead, past which they stream."""
    return wanted.join(manifest.hint("shuffle_hash"), "pos")


def in_cells(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The manifest as one row for each ``chunk`` positions, with their items."""
    return manifest.groupBy(_cell(F.col("pos"), chunk).alias("cell")).agg(
        F.max("pos").alias("last"), F.sort_array(F.collect_list(F.struct("pos", "image_id"))).alias("items")
    )


def _cell(pos: Column, chunk: int) -> Column:
    return F.floor((pos - 1) / chunk)


def at_ranges(ranges: DataFrame, cells: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(uid, image_id) for all positions above ``low``, up to ``high``, of a user.

    A user travels as one row for each cell met, never as positions. All users may want
    the same cell, as in the first delivery: they are dealt into shares, a cell is
    copied to the shares that want it, and items come out behind the shuffle. The number
    of tasks follows from them, as small rows would be joined in one task. ``ranges``
    is read three times and has to be a table.
    """
    tasks = max(1, -(-ranges.count() * chunk // TASK_ITEMS))
    met = F.sequence(_cell(F.col("low") + 1, chunk), _cell(F.col("high"), chunk))
    asked = ranges.select(
        "uid", "low", "high", F.explode(met).alias("cell"),
        F.pmod(F.xxhash64("uid"), F.lit(tasks * SHARES)).alias("share"),
    )
    copies = asked.select("cell", "share").distinct().join(cells.select("cell", "items"), "cell")
    both = asked.repartition(tasks, "cell", "share").join(copies.hint("shuffle_hash"), ["cell", "share"])
    given = both.select("uid", "low", "high", F.inline("items"))
    return given.filter((F.col("pos") > F.col("low")) & (F.col("pos") <= F.col("high"))).select("uid", "image_id")


def flagged_manifest(manifest: DataFrame, delivered: DataFrame) -> DataFrame:
    """Manifest rows with a mark for those one user already has."""
    got = delivered.select("image_id", F.lit(True).alias("downloaded")).distinct()
    return manifest.join(got, "image_id", "left").withColumn(
        "downloaded", F.col("downloaded").isNotNull()
    )


def delivery_totals(manifest: DataFrame, delivered: DataFrame) -> DataFrame:
    """Per user: manifest size, recorded deliveries, the simple difference of
    both, and the exact number of items still to deliver."""
    total = manifest.agg(F.count(F.lit(1))).scalar()
    still = delivered.join(
        manifest.select("image_id", F.lit(1).alias("listed")), "image_id", "left"
    )
    return still.groupBy("uid").agg(
        F.count(F.lit(1)).alias("downloaded"),
        F.count("listed").alias("in_manifest"),
    ).select(
        "uid", total.alias("total"), "downloaded",
        (total - F.col("downloaded")).alias("pending"),
        (total - F.col("in_manifest")).alias("pending_exact"),
    )


def record_delivery(delivered: DataFrame, batch: DataFrame, ts: Column) -> DataFrame:
    """Rows to append: deliveries not recorded before."""
    return (
        batch.select("uid", "image_id").distinct()
        .join(delivered, ["uid", "image_id"], "left_anti")
        .withColumn("ts", ts)
    )

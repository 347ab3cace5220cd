"""Status, cost, yield and funnel reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figureyard.functions.columns import PREFIX_CHARS, ratio, utc_instant

# Supply control of the harvest loop.
MIN_SAMPLE, DEFAULT_YIELD, LOWEST_YIELD, HEADROOM, BUFFER_CAP = 30, 3.0, 0.5, 1.3, 1500


def status_counts(df: DataFrame, group: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """Total and per-status counts in one pass, without a pivot job."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses],
    )


def side_by_side(parts: Sequence[DataFrame]) -> DataFrame:
    """One row from several one-row aggregates, each a scalar subquery."""
    names = [f"__{i}" for i in range(len(parts))]
    rows = [part.select(F.struct("*")).scalar().alias(n) for n, part in zip(names, parts)]
    return parts[0].sparkSession.range(1).select(*rows).select(*[f"{n}.*" for n in names])


def pipeline_counters(papers: DataFrame, pages: DataFrame, batches: DataFrame,
                      images: DataFrame) -> DataFrame:
    """The twelve counters of a curation run, one scan per table."""
    n = F.count(F.lit(1))
    status = F.col("status")
    cost = F.coalesce(F.sum("cost"), F.lit(0.0))
    p = papers.agg(
        n.alias("papers_total"),
        F.count_if(status == "pending").alias("papers_pending"),
        F.count_if(status == "downloaded").alias("papers_downloaded"),
    )
    g = pages.agg(
        n.alias("pages_total"),
        F.count_if(status.isin("pending", "screen_pos")).alias("pages_pending"),
        F.count_if(F.col("has_diagram")).alias("pages_diagram"),
        cost.alias("page_cost"),
    )
    b = batches.agg(F.count_if(status.isin("building", "pending")).alias("batches_pending"))
    i = images.agg(
        n.alias("images_total"),
        F.count_if(status == "pending").alias("images_pending"),
        F.count_if(status == "labeled").alias("labeled"),
        F.count_if(status == "rejected").alias("rejected"),
        cost.alias("image_cost"),
    )
    one = side_by_side([p, g, b, i])
    return one.withColumn("cost", F.col("page_cost") + F.col("image_cost")).drop(
        "page_cost", "image_cost"
    )


def least_served(papers: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """The field with waiting papers that has been served least. Served means
    downloaded papers, or accepted crops when ``accepted`` is given."""
    if accepted is None:
        counts = (
            papers.groupBy("field")
            .agg(
                F.count_if(F.col("status") == "downloaded").alias("done"),
                F.count_if(F.col("status") == "pending").alias("waiting"),
            )
            .filter(F.col("waiting") > 0)
        )
    else:
        waiting = papers.filter(F.col("status") == "pending").select("field").distinct()
        done = accepted.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
        counts = waiting.join(done, "field", "left").select(
            "field", F.coalesce("n", F.lit(0)).alias("done")
        )
    return counts.orderBy("done", "field").limit(1).select("field", "done")


def top_values(df: DataFrame, value: Column, name: str, k: int) -> DataFrame:
    counts = df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), name).limit(k)


def reason_prefix(reason: Column) -> Column:
    return F.substring(reason, 1, PREFIX_CHARS)


def funnel(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Count per stage and its share of the stage before."""
    counts = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(i).alias("step"), F.lit(name).alias("stage"), "n"
            )
            for i, (name, df) in enumerate(stages)
        ],
    )
    # one row per stage, so the unpartitioned window sees a handful of rows
    return counts.withColumn(
        "share", F.bround(ratio(F.col("n"), F.lag("n").over(Window.orderBy("step"))), 4)
    )


def demand(counters: DataFrame, target: int) -> DataFrame:
    """Papers still needed for ``target`` accepted crops and the buffer size."""
    known = (F.col("papers_downloaded") >= MIN_SAMPLE) & (F.col("labeled") >= MIN_SAMPLE)
    observed = F.greatest(
        F.lit(LOWEST_YIELD), ratio(F.col("labeled"), F.col("papers_downloaded"))
    )
    remaining = F.lit(target) - F.col("labeled")
    return (
        counters.withColumn("est_yield", F.when(known, observed).otherwise(DEFAULT_YIELD))
        .withColumn("needed", (remaining / F.col("est_yield") * HEADROOM).cast("int"))
        .select(
            remaining.alias("remaining"),
            F.bround("est_yield", 4).alias("est_yield"),
            "needed",
            F.least("needed", F.lit(BUFFER_CAP)).alias("buffer_target"),
        )
    )


def throughput(log: DataFrame, done: Column, target: int) -> DataFrame:
    """Finished items, items per hour and seconds left at that rate."""
    # the log's times carry no zone; as UTC their difference has no clock changes
    last, first = utc_instant(F.max("ts")), utc_instant(F.min("ts"))
    seconds = F.unix_seconds(last) - F.unix_seconds(first)
    base = log.agg(F.count_if(done).alias("done"), seconds.alias("seconds"))
    rate = ratio(F.col("done"), F.col("seconds"))
    left = F.greatest(F.lit(target) - F.col("done"), F.lit(0))
    return base.select(
        "done", "seconds",
        F.bround(rate * 3600, 4).alias("per_hour"),
        F.bround(ratio(left, rate), 2).alias("seconds_left"),
    )


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of items two judges agree on and the ratio of their mean costs."""
    both = a.join(b, list(keys))
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.bround(F.avg((F.col("verdict_a") == F.col("verdict_b")).cast("double")), 4).alias("agree"),
        F.bround(ratio(F.avg("cost_b"), F.avg("cost_a")), 4).alias("cost_ratio"),
    )

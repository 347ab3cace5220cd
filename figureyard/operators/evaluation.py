"""Metrics, intervals, tests and threshold sweeps over prediction tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figureyard.functions.columns import ratio
from figureyard.operators.reports import side_by_side
from figureyard.schemas import CLASSES

CELLS = ("tp", "fp", "fn", "tn")

# Metrics as SQL over the four cells; callers may pass their own.
METRICS = {
    "acc": "(tp + tn) / greatest(tp + fp + fn + tn, 1)",
    "precision": "coalesce(try_divide(tp, tp + fp), 0D)",
    "recall": "coalesce(try_divide(tp, tp + fn), 0D)",
    "f1": "coalesce(try_divide(2 * tp, 2 * tp + fp + fn), 0D)",
}


def cells(df: DataFrame, truth: Column, guess: Column, by: Sequence[str] = ()) -> DataFrame:
    """The four confusion cells of a yes/no decision in one pass."""
    return df.groupBy(*by).agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(~truth & ~guess).alias("tn"),
    )


def metrics(counts: DataFrame, keep: Sequence[str] = (), digits: int = 4) -> DataFrame:
    return counts.select(
        *keep,
        *[F.bround(F.expr(sql).cast("double"), digits).alias(m) for m, sql in METRICS.items()],
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"),
    )


def binary_metrics(df: DataFrame, truth: Column, guess: Column,
                   by: Sequence[str] = ()) -> DataFrame:
    return metrics(cells(df, truth, guess, by), by)


def class_accuracy(df: DataFrame, truth: str, guess: str) -> DataFrame:
    hit = (F.col(truth) == F.col(guess)).cast("double")
    return df.agg(F.bround(F.avg(hit), 4).alias("acc4"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: str, guess: str, k: int = len(CLASSES)) -> DataFrame:
    """Rows are true classes in fixed order, columns predicted ones; zeros stay."""
    rows = df.sparkSession.range(k).select(F.col("id").cast("int").alias("truth"))
    counted = df.groupBy(F.col(truth).cast("int").alias("truth")).agg(
        *[F.count_if(F.col(guess) == i).alias(f"pred_{i}") for i in range(k)]
    )
    return rows.join(counted, "truth", "left").na.fill(0)


def slices(df: DataFrame, by: str, truth: Column, guess: Column, at_least: int = 10) -> DataFrame:
    """Accuracy per slice with enough rows; unknown slices are ``?``."""
    return (
        df.groupBy(F.coalesce(by, F.lit("?")).alias(by))
        .agg(
            F.bround(F.avg((truth == guess).cast("double")), 4).alias("acc"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter(F.col("n") >= at_least)
    )


def bootstrap(
    counts: DataFrame, metric: str, resamples: int = 1000, seed: int = 0
) -> DataFrame:
    """Point value and 95 % percentile interval (point, lo, hi) of a metric over
    the four cells.

    Resampling rows with replacement only depends on how many rows lie in each
    cell, and these counts follow a multinomial: each resample draws them at
    once, whatever the number of rows.
    """
    spark = counts.sparkSession
    row = counts.select(*CELLS).first()
    n = sum(row)
    share = [c / max(n, 1) for c in row]
    if n == 0:
        share[-1] = 1.0

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def draw(b: pd.Series) -> pd.Series:
        return pd.Series(
            [np.random.default_rng([seed, int(i)]).multinomial(n, share).tolist() for i in b]
        )

    drawn = spark.range(resamples).select(draw("id").alias("c")).select(
        *[F.get("c", i).alias(c) for i, c in enumerate(CELLS)]
    )
    point = counts.select(F.expr(metric).cast("double").alias("point"))
    # one row per resample: a bounded group
    return drawn.select(F.expr(metric).cast("double").alias("m")).agg(
        point.scalar().alias("point"),
        F.expr("percentile(m, 0.025)").alias("lo"), F.expr("percentile(m, 0.975)").alias("hi"),
    )


def grouped_intervals(
    counts: DataFrame, by: Sequence[str], metrics: dict[str, str], resamples: int = 1000,
    seed: int = 0,
) -> DataFrame:
    """Bootstrap intervals of several metrics for each row of cell counts:
    ``<metric>_lo`` and ``<metric>_hi``. One set of draws serves all metrics."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def draw(b: pd.Series, tp: pd.Series, fp: pd.Series, fn: pd.Series, tn: pd.Series) -> pd.Series:
        out = []
        for i, *row in zip(b, tp, fp, fn, tn):
            n = sum(row)
            share = [c / n for c in row] if n else [0.0, 0.0, 0.0, 1.0]
            out.append(np.random.default_rng([seed, int(i)]).multinomial(n, share).tolist())
        return pd.Series(out)

    each = counts.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    drawn = each.select(*by, draw("b", *CELLS).alias("c")).select(
        *by, *[F.get("c", i).alias(c) for i, c in enumerate(CELLS)]
    )
    values = drawn.select(*by, *[F.expr(sql).cast("double").alias(m) for m, sql in metrics.items()])
    return values.groupBy(*by).agg(
        *[
            F.expr(f"percentile({m}, {q})").alias(f"{m}_{end}")
            for m in metrics for end, q in (("lo", 0.025), ("hi", 0.975))
        ]
    )


def evaluation_report(
    judged: DataFrame, by: Sequence[str] = ("name", "side"), k: int = len(CLASSES),
    at_least: int = 10, resamples: int = 1000,
) -> DataFrame:
    """Everything told of a prediction set against one side of labels, a row each.

    ``judged`` has ``by``, y4, pred4 and field; rows without a class on either hand
    leave. Returned: binary metrics, n, acc4, ``<acc|f1>_<lo|hi>``, ``confusion``
    (rows are true classes) and ``slices`` (field, hits, n; binary, with at least
    ``at_least`` rows, unknown fields are ``?``). Rows shrink to counts of (truth,
    guess, field) in one pass; all else comes from these.
    """
    by = list(by)
    known = judged.filter(F.col("y4").between(0, k - 1) & F.col("pred4").between(0, k - 1))
    field = F.coalesce("field", F.lit("?")).alias("field")
    counts = known.groupBy(*by, field, "y4", "pred4").agg(F.count(F.lit(1)).alias("c"))
    y, g = F.col("y4") == 0, F.col("pred4") == 0

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))

    table = F.array(*[
        F.array(*[total((F.col("y4") == i) & (F.col("pred4") == j)) for j in range(k)]) for i in range(k)
    ])
    whole = counts.groupBy(*by).agg(
        total(y & g).alias("tp"), total(~y & g).alias("fp"), total(y & ~g).alias("fn"),
        total(~y & ~g).alias("tn"), table.alias("confusion"),
        F.bround(total(F.col("y4") == F.col("pred4")) / F.sum("c"), 4).alias("acc4"),
    )
    parts = counts.groupBy(*by, "field").agg(total(y == g).alias("hits"), F.sum("c").alias("n"))
    listed = parts.filter(F.col("n") >= at_least).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("field", "hits", "n"))).alias("slices")
    )
    ends = grouped_intervals(whole, by, {m: METRICS[m] for m in ("acc", "f1")}, resamples)
    out = metrics(whole, [*by, "acc4", "confusion"]).join(ends, by).join(listed, by, "left")
    return out.withColumn("slices", F.coalesce("slices", F.array().cast(listed.schema["slices"].dataType)))


def _tail(stat: pd.Series) -> pd.Series:
    return stat.map(lambda s: math.erfc(math.sqrt(s / 2)))


def mcnemar(df: DataFrame, truth: Column, a: Column, b: Column) -> DataFrame:
    """Discordant counts, continuity-corrected statistic and its p value."""
    ok_a, ok_b = a == truth, b == truth
    counts = df.agg(
        F.count_if(ok_a & ~ok_b).alias("n10"), F.count_if(~ok_a & ok_b).alias("n01")
    )
    gap = F.abs(F.col("n10") - F.col("n01")) - 1
    both = F.col("n10") + F.col("n01")
    stat = gap * gap / F.greatest(both, F.lit(1)).cast("double")
    tail = F.pandas_udf(_tail, T.DoubleType())
    return counts.withColumn("stat", stat).withColumn(
        "p", F.when(both > 0, tail("stat")).otherwise(1.0)
    )


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa from pair counts; marginals come from the same counts."""
    pairs = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rows = pairs.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("ra"))
    cols = pairs.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("rb"))
    chance = rows.join(cols, "c").agg(
        F.coalesce(F.sum(F.col("ra") * F.col("rb")), F.lit(0)).alias("e")
    )
    seen = pairs.agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))).alias("same")
    )
    n = F.col("n").cast("double")
    one = side_by_side([seen, chance])
    po, pe = F.coalesce("same", F.lit(0)) / n, F.col("e") / (n * n)
    return one.select(
        F.col("n").alias("n"), (F.col("n") - F.coalesce("same", F.lit(0))).alias("disagreements"),
        F.bround(ratio(po - pe, 1 - pe), 4).alias("kappa"),
    )


def grid_points(start: int = 5, stop: int = 100, step: int = 5) -> list[float]:
    return [i / 100 for i in range(start, stop, step)]


def band_sweep(
    df: DataFrame, truth: Column, score: str, target: float, min_decided: float = 0.3,
    points: Sequence[float] | None = None,
) -> DataFrame:
    """Abstention bands: accept from ``hi`` up, reject from ``lo`` down.

    Rows are first counted by the grid position of their score, on an edge or
    between two, and the truth. The sweep then runs over at most twice the grid
    size of counts, whatever the number of rows.
    """
    points = list(points or grid_points())
    edges = F.array(*[F.lit(v) for v in points])
    s = F.col(score)
    # 2k: exactly on edge k (1-based); 2k + 1: between edges k and k + 1
    below = F.size(F.filter(edges, lambda e: e < s))
    on = F.exists(edges, lambda e: e == s).cast("int")
    place = F.when(on == 1, (below + 1) * 2).otherwise(below * 2 + 1)
    hist = df.groupBy(place.alias("place")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(truth).alias("pos")
    )
    # one list of at most 2 * grid + 1 counts, read by every pair of thresholds
    listed = hist.agg(F.collect_list(F.struct("place", "n", "pos")).alias("h")).scalar()
    size = len(points)
    pairs = (
        df.sparkSession.range(size * size)
        .select(
            F.floor(F.col("id") / size).cast("int").alias("lo_ord"),
            (F.col("id") % size).cast("int").alias("hi_ord"),
        )
        .filter(F.col("hi_ord") >= F.col("lo_ord"))
        .select(
            "lo_ord", "hi_ord", F.get(edges, "lo_ord").alias("lo"), F.get(edges, "hi_ord").alias("hi"),
            listed.alias("h"),
        )
    )

    def total(cond: Callable[[Column, Column], Column], value: Callable[[Column], Column]) -> Column:
        def step(acc: Column, x: Column) -> Column:
            accept = x["place"] >= (F.col("hi_ord") + 1) * 2
            reject = x["place"] <= (F.col("lo_ord") + 1) * 2
            return acc + F.when(cond(accept, reject), value(x)).otherwise(F.lit(0))

        return F.aggregate("h", F.lit(0).cast("bigint"), step)

    swept = pairs.withColumns(
        {
            "all": total(lambda a, r: F.lit(True), lambda x: x["n"]),
            "decided": total(lambda a, r: a | r, lambda x: x["n"]),
            # a row on lo = hi is accepted and rejected: correct either way
            "both": total(lambda a, r: a & r, lambda x: x["n"]),
            "right_accept": total(lambda a, r: a & ~r, lambda x: x["pos"]),
            "right_reject": total(lambda a, r: r & ~a, lambda x: x["n"] - x["pos"]),
            "accepted": total(lambda a, r: a, lambda x: x["n"]),
            "accepted_pos": total(lambda a, r: a, lambda x: x["pos"]),
        }
    )
    decided = F.col("decided")
    table = swept.filter(decided >= F.col("all") * min_decided).select(
        "lo_ord", "hi_ord", "lo", "hi",
        F.bround(ratio(decided, F.col("all")), 4).alias("coverage"),
        F.bround(
            ratio(F.col("both") + F.col("right_accept") + F.col("right_reject"), decided), 4
        ).alias("decided_acc"),
        F.bround(ratio(F.col("accepted_pos"), F.col("accepted")), 4).alias("accept_precision"),
    )
    return table.withColumn("ok", F.col("accept_precision") >= target)


def best_band(table: DataFrame) -> DataFrame:
    """Widest coverage among bands that reach the target precision, else the
    most precise band; the first in grid order wins ties."""
    rank = F.struct(
        "ok",
        F.when(F.col("ok"), F.col("coverage")).otherwise(F.col("accept_precision")).alias("v"),
        (-F.col("lo_ord")).alias("a"), (-F.col("hi_ord")).alias("b"),
    )
    row = F.struct("lo", "hi", "coverage", "decided_acc", "accept_precision", "ok")
    return table.agg(F.max_by(row, rank).alias("r")).select("r.*")


def top_bands(table: DataFrame, k: int = 200) -> DataFrame:
    return table.orderBy(F.desc("coverage"), "lo_ord", "hi_ord").limit(k)


# Grid of the page detector sweep.
CONF_GRID, AREA_GRID = (0.2, 0.3, 0.4, 0.5, 0.6), (0.01, 0.03, 0.05)


def detector_sweep(
    boxes: DataFrame, page: str, confs: Sequence[float] = CONF_GRID,
    areas: Sequence[float] = AREA_GRID,
) -> DataFrame:
    """Confusion cells of every (confidence, area) threshold.

    Per page only the best figure confidence at each area threshold matters, so
    boxes shrink to one row per page before any threshold is applied.
    """
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    figure = F.col("cls") == "figure"
    best = boxes.groupBy(page).agg(
        F.max("has_diagram").alias("y"),
        *[
            F.max(
                F.when(figure & (size >= F.lit(a) * F.col("w") * F.col("h")), F.col("conf"))
            ).alias(f"best_{i}")
            for i, a in enumerate(areas)
        ],
    )
    y = F.col("y") == 1
    guesses = [
        (c, a, F.coalesce(F.col(f"best_{i}") >= c, F.lit(False)))
        for c in confs
        for i, a in enumerate(areas)
    ]
    wide = best.agg(
        *[
            F.struct(
                F.lit(k).alias("ord"), F.lit(float(c)).alias("conf_t"),
                F.lit(float(a)).alias("area_t"),
                F.count_if(y & g).alias("tp"), F.count_if(~y & g).alias("fp"),
                F.count_if(y & ~g).alias("fn"), F.count_if(~y & ~g).alias("tn"),
            ).alias(f"s{k}")
            for k, (c, a, g) in enumerate(guesses)
        ]
    )
    rows = wide.select(F.inline(F.array(*[F.col(f"s{k}") for k in range(len(guesses))])))
    return metrics(rows, ("ord", "conf_t", "area_t"))


def first_best(table: DataFrame, metric: str, order: str) -> DataFrame:
    row = F.struct(*table.columns)
    return table.agg(
        F.max_by(row, F.struct(F.col(metric), -F.col(order))).alias("r")
    ).select("r.*")

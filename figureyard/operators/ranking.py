"""Exact positions inside groups that may be far larger than one task.

A plain ``row_number`` window sends a whole group to one task. Here a group is
cut into order-preserving buckets: rows are numbered inside a bucket, and the
counts of all earlier buckets are added. Buckets are small by construction
(a fixed range of unique ids), or cut at bounds from a sample of the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figureyard.session import materialised

IDS_PER_BUCKET = 65536
ROWS_PER_BUCKET = 1 << 18


def seeded_hash(seed: str | int, *cols: Column) -> Column:
    """Uniform order key of a row: equal on every engine and every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def id_bucket(key: Column, width: int = IDS_PER_BUCKET) -> Column:
    return F.floor(key / width)


def in_even_buckets(
    df: DataFrame, by: Sequence[str | Column], name: str, rows: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Cut ``df`` into ordered buckets of about ``rows`` rows whatever the keys:
    the bounds come from a sample of the keys in use. Equal keys share a bucket.
    Written once, as two samples of one table need not give the same bounds."""
    parts = max(1, -(-df.count() // rows))
    cut = df.repartitionByRange(parts, *by).withColumn(name, F.spark_partition_id())
    return materialised(cut, "even-buckets")


def rank_within(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    bucket: Sequence[Column] | None = None,
    name: str = "rn",
    total: str | None = None,
    before: dict[str, str] | None = None,
    rows: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the 1-based position of each row in its group as ``name``.

    ``bucket`` must grow with ``order``; without one, buckets of about ``rows``
    rows are cut from a sample of the keys, which holds for any distribution.
    ``total`` also adds the group size, ``before`` (new column: numeric column)
    the sums over all earlier rows of the group. Group columns and given buckets
    must not be null.
    """
    if bucket is None:
        keys = ["__bucket"]
        cut = in_even_buckets(df, [*group, *order], "__bucket", rows)
    else:
        keys = [f"__bucket{i}" for i in range(len(bucket))]
        cut = df.withColumns(dict(zip(keys, bucket)))
    before = before or {}
    cell = [*group, *keys]
    counts = cut.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__sum_{n}") for n, c in before.items()]
    )
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    earlier = whole.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    added = {"__before": F.coalesce(F.sum("__n").over(earlier), F.lit(0))}
    for n in before:
        added[f"__before_{n}"] = F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0))
    if total:
        added[total] = F.sum("__n").over(whole)
    offsets = counts.withColumns(added).drop("__n", *[f"__sum_{n}" for n in before])
    inside = Window.partitionBy(*cell).orderBy(*order)
    local = {"__local": F.row_number().over(inside)}
    for n, c in before.items():
        up_to_here = inside.rowsBetween(Window.unboundedPreceding, -1)
        local[f"__local_{n}"] = F.coalesce(F.sum(c).over(up_to_here), F.lit(0))
    found = {name: F.col("__before") + F.col("__local")}
    for n in before:
        found[n] = F.col(f"__before_{n}") + F.col(f"__local_{n}")
    spent = [f"__{kind}_{n}" for n in before for kind in ("before", "local")]
    return (
        cut.withColumns(local)
        .join(offsets, cell)
        .withColumns(found)
        .drop("__before", "__local", *spent, *keys)
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the smallest ``order`` per key, combined before the shuffle."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    return (
        df.groupBy(*keys).agg(F.min_by(row, order).alias("__row")).select(*keys, "__row.*")
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    row = F.struct(*[c for c in df.columns if c not in keys])
    return (
        df.groupBy(*keys).agg(F.max_by(row, order).alias("__row")).select(*keys, "__row.*")
    )


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "rn"
) -> DataFrame:
    """First ``n`` rows per group. Spark trims every map partition to ``n`` rows
    per group before the shuffle, so a hot group never travels whole."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def exact_percentiles(
    df: DataFrame, group: Sequence[str], value: str, points: dict[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Linearly interpolated percentiles without holding a group in one task.

    A sketch brackets each wanted position between two values; rows below the
    bracket are only counted, and the few values inside it, wherever they lie,
    are numbered. A bracket reaches one value further on both sides, which covers
    the position beside the sketch's own where groups are small.
    """
    known = df.filter(F.col(value).isNotNull())
    values = materialised(
        known.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n")), "percentile-values"
    )
    margin = 2 / accuracy
    ends = [e for q in points.values() for e in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = known.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__total"),
        F.percentile_approx(value, F.array(*map(F.lit, ends)), F.lit(accuracy)).alias("__ends"),
    )
    point = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"), F.lit(q).alias("q"),
                F.get("__ends", F.lit(2 * i)).alias("lo"), F.get("__ends", F.lit(2 * i + 1)).alias("hi"),
            )
            for i, (label, q) in enumerate(points.items())
        ]
    )
    wanted = sketch.select(*group, "__total", F.inline(point))
    cell = [*group, "label"]
    v = F.col(value)

    def of_group(rows: DataFrame) -> DataFrame:
        return values.join(rows, list(group)) if group else values.join(F.broadcast(rows))

    bracket = of_group(wanted).groupBy(*cell, "q", "__total").agg(
        F.coalesce(F.max(F.when(v < F.col("lo"), v)), F.min("lo")).alias("first"),
        F.coalesce(F.min(F.when(v > F.col("hi"), v)), F.max("hi")).alias("last"),
    )
    bracket = materialised(bracket, "percentile-brackets")
    near = of_group(bracket)
    below = near.filter(v < F.col("first")).groupBy(*cell).agg(F.sum("__n").alias("__begin"))
    inside = (
        Window.partitionBy(*cell).orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    numbered = (
        near.filter((v >= F.col("first")) & (v <= F.col("last")))
        .withColumn("__upto", F.sum("__n").over(inside))
        .join(below, cell, "left")
        .withColumn("__upto", F.col("__upto") + F.coalesce("__begin", F.lit(0)))
        .withColumn("__from", F.col("__upto") - F.col("__n"))
    )
    exact = (F.col("__total") - 1) * F.col("q")
    holds = [(at >= F.col("__from")) & (at < F.col("__upto")) for at in (F.floor(exact), F.ceil(exact))]
    parts = (
        numbered.filter(holds[0] | holds[1]).groupBy(*cell)
        .agg((F.min(value) + (F.max(value) - F.min(value)) * F.max(exact - F.floor(exact))).alias("__p"))
    )
    return parts.groupBy(*group).agg(
        *[F.max(F.when(F.col("label") == label, F.col("__p"))).alias(label) for label in points]
    )

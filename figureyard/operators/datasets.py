"""Dataset assembly: silver classes, capped negatives, leak-free splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figureyard.operators.gates import silver_class
from figureyard.operators.ranking import rank_within, seeded_hash
from figureyard.schemas import CLASSES, SPLITS

# Seed and fractions of the published split.
SEED, TRAIN_FRAC, VAL_FRAC, TRIVIAL_CAP = 20260716, 0.70, 0.15, 600


def silver_crops(images: DataFrame, path: Column) -> DataFrame:
    made = silver_class(F.col("status"), F.col("reject_reason"))
    return (
        images.filter(F.col("status").isin("labeled", "rejected"))
        .withColumn("__made", made)
        .select(
            "image_id", path.alias("path"), F.col("__made.cls").alias("cls"), "field",
            "arxiv_id", F.col("__made.source").alias("source"),
        )
    )


def seeded_sample(df: DataFrame, key: str, n: int, seed: str | int = SEED) -> DataFrame:
    """``n`` rows in seeded hash order: every task keeps ``n``, then they merge."""
    h = seeded_hash(seed, F.col(key))
    return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")


def cap_trivial(crops: DataFrame, cap: int = TRIVIAL_CAP, seed: int = SEED) -> DataFrame:
    """At most ``cap`` locally rejected crops; all other crops stay."""
    trivial = F.col("source") == "local"
    return crops.filter(~trivial).unionByName(
        seeded_sample(crops.filter(trivial), "image_id", cap, seed)
    )


def paper_fields(crops: DataFrame, pages: DataFrame) -> DataFrame:
    """One field per paper; the field of a crop wins over that of a page."""
    both = crops.select("arxiv_id", F.col("field").alias("cf"), F.lit(None).cast("string").alias("pf"))
    both = both.unionByName(
        pages.select("arxiv_id", F.lit(None).cast("string").alias("cf"), F.col("field").alias("pf"))
    )
    return both.groupBy("arxiv_id").agg(F.coalesce(F.min("cf"), F.min("pf")).alias("field"))


def assign_splits(papers: DataFrame, seed: int = SEED) -> DataFrame:
    """Stratified split of distinct papers. Positions inside a field follow a
    seeded hash and are counted per even bucket, so a field is never one task."""
    h = seeded_hash(seed, F.col("arxiv_id"))
    ranked = rank_within(
        papers.withColumn("__h", h), ["field"], [F.col("__h"), F.col("arxiv_id")],
        name="__pos", total="__all",
    )
    n_train = F.bround(F.col("__all") * F.lit(TRAIN_FRAC), 0)
    n_val = F.bround(F.col("__all") * F.lit(VAL_FRAC), 0)
    split = (
        F.when(F.col("__pos") <= n_train, "train")
        .when(F.col("__pos") <= n_train + n_val, "val")
        .otherwise("test")
    )
    return ranked.select("arxiv_id", "field", split.alias("split"))


def with_split(rows: DataFrame, splits: DataFrame) -> DataFrame:
    return rows.join(splits.select("arxiv_id", "split"), "arxiv_id")


def class_by_split(rows: DataFrame, cls: str = "cls") -> DataFrame:
    """Contingency of classes and splits in one aggregation; zeros are kept."""
    return rows.groupBy(cls).agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    )


def split_violations(rows: DataFrame) -> DataFrame:
    """Papers that appear in more than one split; must be empty."""
    return (
        rows.groupBy("arxiv_id")
        .agg(F.min("split").alias("a"), F.max("split").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .select("arxiv_id")
    )


def split_digest(splits: DataFrame, digits: int = 3) -> DataFrame:
    """Content hash of the split map: sorted row digests are hashed per bucket,
    then the bucket digests are hashed, so no task holds the whole map."""
    row = F.sha2(F.concat_ws("|", "arxiv_id", "split"), 256)
    per_bucket = (
        splits.select(row.alias("d"))
        .groupBy(F.substring("d", 1, digits).alias("b"))
        .agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return per_bucket.agg(
        F.substring(
            F.sha2(
                F.array_join(
                    F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]),
                    "",
                ),
                256,
            ),
            1, 16,
        ).alias("manifest_sha"),
        F.sum("n").alias("papers"),
    )


def repeated_sample(df: DataFrame, key: str, n: int, seed: str | int = SEED) -> DataFrame:
    """Exactly ``n`` positions; when there are fewer rows they repeat in turn."""
    picked = seeded_sample(df.select(key), key, n, seed)
    placed = picked.select(
        F.sort_array(F.collect_list(F.struct(seeded_hash(seed, F.col(key)).alias("h"), key))).alias("a")
    )
    # n is the size of the sample itself, so this one row holds n keys at most.
    return placed.select(
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(n - 1)),
                lambda i: F.get(F.col("a"), (i % F.size("a")).cast("int"))[key],
            )
        ).alias("pos", key)
    ).filter(F.col(key).isNotNull())


def rating_lists(items: DataFrame, n: int, raters: list[str], seed: int = SEED) -> DataFrame:
    """Blind rating lists: the same ``n`` test items without labels, in an
    independent order per rater."""
    sample = seeded_sample(
        items.filter(F.col("split") == "test").select("image_id", "path"), "image_id", n, seed
    )
    spread = sample.withColumn("rater", F.explode(F.array(*[F.lit(r) for r in raters])))
    return spread.select(
        "rater", "image_id", "path",
        F.md5(F.concat_ws("|", "rater", F.col("image_id").cast("string"))).alias("sort_key"),
    )


def class_weights(labels: DataFrame, y: str = "y4", k: int = len(CLASSES)) -> DataFrame:
    """Balanced and square-root inverse-frequency weight of every class."""
    counts = labels.groupBy(y).agg(F.count(F.lit(1)).alias("n_c"))
    total = counts.agg(F.sum("n_c").alias("n")).scalar()
    return counts.select(
        y, "n_c",
        (total / (F.lit(k) * F.col("n_c"))).alias("balanced"),
        F.sqrt(total / F.greatest("n_c", F.lit(1))).alias("inv_sqrt"),
    )

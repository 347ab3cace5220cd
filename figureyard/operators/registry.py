"""Registration, work queues and state folds over the decision log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figureyard.functions.columns import ERROR_CHARS, OCR_CHARS, REASON_CHARS
from figureyard.operators.ranking import first_per_key, top_per_group

def register_first_wins(batch: DataFrame, known: DataFrame, arrival: str) -> DataFrame:
    """New records of ``batch``: the first arrival per version-less id that is
    not registered yet, under any field. Copies are combined before the shuffle."""
    first = first_per_key(batch, ["base_id"], F.col(arrival))
    return first.join(known.select("base_id").distinct(), "base_id", "left_anti")


def harvest_in_order(entries: DataFrame, key: str, order: str, total: int) -> DataFrame:
    """Distinct entries in feed order, stopping after ``total``."""
    return (
        first_per_key(entries.withColumn("__at", F.col(order)), [key], F.col("__at"))
        .drop("__at")
        .orderBy(order)
        .limit(total)
    )


def explode_pages(papers: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """One row per page up to ``cap`` that is not registered yet."""
    pages = papers.select(
        "arxiv_id", F.explode(F.sequence(F.lit(1), F.least("n_pages", F.lit(cap)))).alias("page_no")
    )
    return pages.join(known.select("arxiv_id", "page_no"), ["arxiv_id", "page_no"], "left_anti")


def work_queue(
    items: DataFrame, wanted: Column, in_flight: DataFrame | None,
    keys: Sequence[str], order: Sequence[Column], limit: int,
) -> DataFrame:
    """The next ``limit`` items in order that nobody works on."""
    waiting = items.filter(wanted)
    if in_flight is not None:
        waiting = waiting.join(in_flight.select(*keys), list(keys), "left_anti")
    return waiting.orderBy(*order).limit(limit)


def remaining_by_document(
    manifest: DataFrame, done: DataFrame, doc: str, keys: Sequence[str]
) -> DataFrame:
    """Missing outputs, one row per source document with its page list. Pages
    per document are capped at registration, so the list stays short."""
    return (
        manifest.join(done.select(*keys), list(keys), "left_anti")
        .groupBy(doc)
        .agg(F.array_sort(F.collect_list("page_no")).alias("page_list"))
    )


def requeue_failed(
    df: DataFrame, interrupted: str | None = None, needs: Column | None = None
) -> DataFrame:
    """Rows that failed, or stand in the state ``interrupted`` when work starts
    again, go back to pending and lose their error. ``needs`` narrows that."""
    back = F.col("status") == "failed"
    if interrupted:
        back = back | (F.col("status") == interrupted)
    if needs is not None:
        back = back & needs
    back = F.coalesce(back, F.lit(False))
    out = {"requeued": back, "status": F.when(back, "pending").otherwise(F.col("status"))}
    if "error" in df.columns:
        out["error"] = F.when(~back, F.col("error"))
    return df.withColumns(out)


def requeue_assets(images: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Local rows without a file are lost; everything else keeps its status."""
    present = listing.select(F.col(key), F.lit(True).alias("__here")).distinct()
    lost = (F.col("status") == "local") & F.col("__here").isNull()
    return (
        images.join(present, key, "left")
        .withColumn("status", F.when(lost, "lost").otherwise(F.col("status")))
        .drop("__here")
    )


def fold_log(log: DataFrame, key: str, seq: str, cost: str, accumulate: bool) -> DataFrame:
    """Current state per entity. Page costs add up, image costs are replaced.

    Any status is kept as it is. Texts are cut to their stored lengths: errors,
    and reasons and OCR texts where the log has them. ``seq`` is unique per
    entity, so the columns of the latest step come from the same row.
    """
    spent = F.coalesce(F.sum(cost), F.lit(0.0)) if accumulate else F.max_by(cost, seq)
    texts = {"error": ERROR_CHARS, "reject_reason": REASON_CHARS, "ocr_text": OCR_CHARS}
    latest = ["status", *[c for c in texts if c in log.columns]]
    folded = log.groupBy(key).agg(
        F.max_by(F.struct(*latest), seq).alias("__last"),
        spent.alias("cost"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.count(F.lit(1)).alias("steps"),
    )
    cut = [F.substring(f"__last.{c}", 1, texts[c]).alias(c) for c in latest[1:]]
    return folded.select(key, "__last.status", *cut, "cost", "failures", "steps")


def quota(items: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """Up to ``n`` items per group in order."""
    return top_per_group(items, [group], order, n)


def quota_shortage(taken: DataFrame, groups: DataFrame, group: str, n: int) -> DataFrame:
    counts = taken.groupBy(group).agg(F.count(F.lit(1)).alias("taken"))
    return (
        groups.select(group).distinct().join(counts, group, "left")
        .select(
            group,
            F.coalesce("taken", F.lit(0)).alias("taken"),
            (F.lit(n) - F.coalesce("taken", F.lit(0))).alias("missing"),
        )
    )


def split_manifest(manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """Mark entries whose page exists as valid; the others are unbatchable."""
    return (
        manifest.join(documents.select("arxiv_id", "page_count"), "arxiv_id", "left")
        .withColumn(
            "valid",
            (F.col("page_no") >= 1)
            & (F.col("page_no") <= F.coalesce("page_count", F.lit(0))),
        )
        .withColumn("batch_id", F.when(F.col("valid"), F.lit(0)).otherwise(F.lit(-1)))
    )


def bookkeeping(writes: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """Latest and first value written per key."""
    return writes.groupBy(key).agg(
        F.max_by(value, seq).alias("latest"), F.min_by(value, seq).alias("first")
    )

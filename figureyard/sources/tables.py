"""The curation tables, derived from the plain parquet tables of a data folder.

The folder holds documents, labels, embeddings, line items and events; these
functions read them as papers, pages, crops, rectangles, predictions and a
decision log. Every function prunes to the columns it needs, so a job that
never asks for a title never reads document text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figureyard.schemas import TABLES

PAGE_W, PAGE_H = 612, 792


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def _base_id(doc_id: Column) -> Column:
    shared = (doc_id % 5 == 0) & (doc_id > 0)
    number = F.when(shared, doc_id - 1).otherwise(doc_id)
    return F.lpad(number.cast("string"), 6, "0")


def papers(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """One paper per document, with the ``more`` columns of it from the same scan."""
    d = table(spark, folder, "documents")
    doc_id = F.col("doc_id")
    return d.select(
        "doc_id",
        F.concat(_base_id(doc_id), F.lit("v"), (doc_id % 3 + 1).cast("string")).alias("arxiv_id"),
        _base_id(doc_id).alias("base_id"),
        F.col("lang").alias("field"),
        "source",
        F.substring_index("text", "\n", 1).alias("title"),
        (F.floor(F.col("n_chars") / 500.0).cast("int") + 1).alias("n_pages"),
        F.when(doc_id % 10 == 0, "failed")
        .when(doc_id % 10 == 1, "pending")
        .otherwise("downloaded")
        .alias("status"),
        "n_chars",
        *more,
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    page = F.col("page_no")
    return (
        papers(spark, folder)
        .select(
            "arxiv_id", "doc_id", "field",
            F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page_no"),
        )
        .select(
            "arxiv_id", "doc_id", "field", "page_no",
            ((F.col("doc_id") + page) % 10 >= 3).alias("has_graphics"),
            ((F.col("doc_id") * 7 + page) % 5 < 2).alias("screen_pos"),
            ((F.col("doc_id") * 11 + page) % 4 != 0).alias("confirm_pos"),
            F.lit(0.25).alias("screen_cost"),
            F.lit(1.5).alias("confirm_cost"),
        )
    )


def images(spark: SparkSession, folder: str) -> DataFrame:
    """One crop per document; labelled documents are the decided ones."""
    labels = table(spark, folder, "labels")
    doc_id = F.col("doc_id")
    decided = (
        F.when(F.col("quality") == 1, "labeled")
        .when(F.col("quality") == 0, "rejected")
        .when(doc_id % 2 == 0, "rejected")
        .otherwise("pending")
    )
    rejected_as = (
        F.when(doc_id % 5 == 0, "local:tiny-file")
        .when(doc_id % 5 == 1, "llm:data plot")
        .when(doc_id % 5 == 2, "llm:photograph")
        .when(doc_id % 5 == 3, "llm:heatmap")
        .otherwise("llm:fragment")
    )
    return (
        papers(spark, folder)
        .join(labels, "doc_id", "left")
        .withColumn("status", decided)
        .select(
            doc_id.alias("image_id"), "arxiv_id", "field",
            (doc_id % F.col("n_pages") + 1).alias("page_no"),
            "status",
            F.when(F.col("status") != "rejected", "").otherwise(rejected_as).alias("reject_reason"),
            F.col("n_chars").alias("file_bytes"),
            (F.lit(40) + doc_id % 900).alias("width"),
            (F.lit(40) + (doc_id * 7) % 700).alias("height"),
            "toxic",
        )
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    vec, cls = F.col("vec_id"), F.col("label") % 4
    wrong = (F.col("label") + 1) % 4
    score = F.when(cls == 0, F.lit(50) + (vec * 37) % 50).otherwise((vec * 37) % 70)
    return table(spark, folder, "embeddings").select(
        vec.alias("image_id"),
        cls.alias("y4"),
        F.when(vec % 5 == 0, wrong).otherwise(cls).alias("pred_a"),
        F.when(vec % 7 == 0, wrong).otherwise(cls).alias("pred_b"),
        (score / F.lit(100.0)).alias("p_diagram"),
        F.concat(F.lit("f"), F.col("label").cast("string")).alias("field"),
    )


def drawn(spark: SparkSession, folder: str) -> DataFrame:
    """Drawing and image rectangles of a page, with copies."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    x0, y0 = (part * 37) % 400, (supp * 53) % 560
    return (
        table(spark, folder, "lineitem")
        .select(
            F.col("l_orderkey").alias("page_key"),
            F.when(F.col("l_linenumber") % 2 == 0, "image").otherwise("vector").alias("kind"),
            x0.alias("x0"),
            y0.alias("y0"),
            (x0 + F.col("l_quantity").cast("int") * 4 + 20).alias("x1"),
            (y0 + (part * 13) % 200 + 20).alias("y1"),
        )
    )


def rects(spark: SparkSession, folder: str) -> DataFrame:
    """The same; copies of a rectangle count once."""
    return drawn(spark, folder).distinct()


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Text blocks of a page. Copies of a block count once."""
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    bx0, by0 = (supp * 29) % 400, (part * 17) % 760
    caption = F.concat(F.lit("Figure "), line.cast("string"))
    prose = F.concat(F.lit("text "), F.col("l_returnflag"), part.cast("string"))
    return (
        table(spark, folder, "lineitem")
        .select(
            F.col("l_orderkey").alias("page_key"),
            bx0.alias("bx0"),
            by0.alias("by0"),
            (bx0 + 150).alias("bx1"),
            (by0 + 12).alias("by1"),
            F.when(line % 3 == 0, caption).otherwise(prose).alias("txt"),
        )
        .distinct()
    )


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Detector boxes: the page rectangles with a class and a confidence."""
    key = F.col("page_key")
    return rects(spark, folder).select(
        "page_key",
        F.when(F.col("kind") == "image", "figure").otherwise("table").alias("cls"),
        ((key * 31 + F.col("x0") * 17 + F.col("y0")) % 100 / F.lit(100.0)).alias("conf"),
        "x0", "y0", "x1", "y1",
        F.when(key % 3 == 0, 1).otherwise(0).alias("has_diagram"),
        F.lit(PAGE_W).alias("w"),
        F.lit(PAGE_H).alias("h"),
    )


DECISION_STATUS = {"error": "failed", "purchase": "labeled", "signup": "rejected"}


def status_of_stage(stage: Column) -> Column:
    """Status that an event of ``stage`` moves its entity to."""
    chain = F
    for name, status in DECISION_STATUS.items():
        chain = chain.when(stage == name, status)
    return chain.otherwise("pending")


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        "ts",
        F.col("user_id").alias("entity"),
        F.col("event_type").alias("stage"),
        status_of_stage(F.col("event_type")).alias("status"),
        F.col("value").alias("cost"),
    )


def downloads(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .filter(F.col("event_type") == "view")
        .select(F.col("user_id").alias("uid"), (F.col("event_id") % 200).alias("image_id"))
        .distinct()
    )


def timings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("model"),
        F.when(F.col("event_id") % 2 == 0, "mps").otherwise("cpu").alias("device"),
        F.col("value").alias("ms"),
    )

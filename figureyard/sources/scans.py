"""Readers of harvested feeds, manifests, journals and model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figureyard import schemas
from figureyard.functions.columns import class_index, squeeze, strip


def feed_records(entries: DataFrame) -> DataFrame:
    """Paper records from parsed feed entries."""
    url = strip(F.coalesce("id", F.lit("")))
    aid = F.substring_index(url, "/abs/", -1)
    pdf = F.get(F.filter("link", lambda x: x["_title"] == "pdf"), 0)["_href"]
    return entries.select(
        aid.alias("arxiv_id"),
        squeeze(F.coalesce("title", F.lit(""))).alias("title"),
        strip(F.coalesce("summary", F.lit(""))).alias("abstract"),
        F.transform("author", lambda a: strip(a["name"])).alias("authors"),
        F.substring("published", 1, 10).alias("published"),
        url.alias("abs_url"),
        F.coalesce(
            F.nullif(pdf, F.lit("")), F.concat(F.lit("https://arxiv.org/pdf/"), aid)
        ).alias("pdf_url"),
    )


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Atom documents, one per file, split at entries by the XML source."""
    entries = (
        spark.read.format("xml").option("rowTag", "entry").schema(schemas.FEED_ENTRY).load(path)
    )
    return feed_records(entries)


def parse_feed(df: DataFrame, xml: str) -> DataFrame:
    """The same for a column that holds one entry per row."""
    parsed = df.select(F.from_xml(F.col(xml), schemas.FEED_ENTRY, {"rowTag": "entry"}).alias("e"))
    return feed_records(parsed.select("e.*"))


def read_crops_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.CROPS_MANIFEST)


def read_pages_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.PAGES_MANIFEST)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold crop labels with the class as its index."""
    rows = spark.read.csv(path, header=True, schema=schemas.GOLD_CROPS)
    return rows.withColumn("gold4", class_index(F.col("gold_cls")))


def read_journal(
    spark: SparkSession, path: str, schema: str, whole_files: bool = False
) -> tuple[DataFrame, DataFrame]:
    """JSON records, one per line or one per file: good records with the page
    number from their path, and unreadable ones on the side instead of failing."""
    rows = (
        spark.read.text(path, wholetext=whole_files)
        .withColumn("file", F.col("_metadata.file_path"))
        .withColumn(
            "r", F.from_json("value", schema + ", _corrupt_record STRING", {"mode": "PERMISSIVE"})
        )
    )
    page = F.nullif(F.regexp_extract("file", r"page_(\d+)", 1), F.lit("")).cast("int")
    rows = rows.withColumn("file_page", page)
    readable = F.col("r._corrupt_record").isNull() & F.col("r").isNotNull()
    good = rows.filter(readable).select("r.*", "file", "file_page").drop("_corrupt_record")
    bad = rows.filter(~readable).select("file", "file_page", "value")
    return good, bad


def list_assets(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files with their size. Contents are never read; sidecar files are left out."""
    name = F.substring_index("path", "/", -1)
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        .select("path", F.col("length").alias("bytes"), name.alias("name"))
        .filter(~F.col("name").startswith("._"))
    )


def split_map_rows(df: DataFrame, text: str) -> DataFrame:
    """(paper, split) rows from JSON split maps, whole or in shards."""
    parsed = F.from_json(F.col(text), schemas.SPLIT_MAP)
    return df.select(F.explode(parsed["papers"]).alias("arxiv_id", "split"))


def read_predictions(spark: SparkSession, path: str, name: str | None = None,
                     split: str | None = None) -> DataFrame:
    """Prediction sets; name and split prune whole directories."""
    df = spark.read.schema(schemas.PREDICTIONS).parquet(path)
    if name is not None:
        df = df.filter(F.col("name") == name)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df


def gallery_items(df: DataFrame) -> DataFrame:
    """Viewer items of gallery documents with an ``images`` array."""
    return _viewer_items(df.select(F.inline("images")))


def read_gallery(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A gallery document, or its scalable form with one image per line."""
    if lines:
        return _viewer_items(spark.read.schema(schemas.GALLERY_LINE).json(path))
    whole = spark.read.schema(schemas.GALLERY).option("multiLine", True).json(path)
    return gallery_items(whole)


def _viewer_items(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("url").alias("key"), F.col("category").alias("field"), "page",
        F.coalesce("caption", F.lit("")).alias("caption"), "arxiv_id",
    )


def detector_entries(df: DataFrame, text: str) -> DataFrame:
    """Page entries of detector output: the key holds paper and page."""
    parsed = F.from_json(F.col(text), schemas.BOXES)
    rows = df.select(F.explode(parsed).alias("key", "e"))
    return rows.select(
        F.split_part("key", F.lit("|"), F.lit(1)).alias("arxiv_id"),
        F.split_part("key", F.lit("|"), F.lit(2)).cast("int").alias("page_no"),
        "e.*",
    )


def fold_ocr(batches: DataFrame, manifest: str, response: str) -> DataFrame:
    """Crops of recognised pages: a page belongs to the manifest entry at its
    index, pages out of range are dropped. Every image advances the ordinal,
    but only images with data become crops."""
    pages = batches.select("*", F.inline(F.col(response)["pages"]))
    entry = F.get(F.col(manifest), F.col("index"))
    placed = pages.filter(
        (F.col("index") >= 0) & (F.col("index") < F.size(manifest))
    ).withColumns({"arxiv_id": entry["arxiv_id"], "page_no": entry["page_no"]})
    spread = placed.select(
        "batch_id", "arxiv_id", "page_no", "markdown", F.posexplode("images").alias("i", "img")
    )
    return spread.select(
        "batch_id", "arxiv_id", "page_no", (F.col("i") + 1).alias("ordinal"),
        F.col("img.id").alias("image_name"), F.col("img.image_base64").alias("uri"),
    ).filter(F.length(F.coalesce("uri", F.lit(""))) > 0)


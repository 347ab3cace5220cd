"""Writers of exports, manifests, predictions, galleries and result ledgers."""

from __future__ import annotations

import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figureyard import schemas
from figureyard.functions.columns import display_name, scrub
from figureyard.functions.vectors import unit_vector
from figureyard.sinks import pieces

# Column headers of the two exports, in order.
WITH_SOURCE = {
    "Field": "field",
    "ArXiv ID": "arxiv_id",
    "Paper Title": "paper_title",
    "Authors": "authors",
    "Published": "published",
    "Abstract URL": "abs_url",
    "PDF URL": "pdf_url",
    "Page": "page_number",
    "Source Image Path": "source_image_path",
    "Image File": "image_file",
    "Diagram Type": "diagram_type",
    "Diagram Title": "diagram_title",
    "Label": "label",
}
WITHOUT_SOURCE = {
    "Field": "field",
    "Image File": "image_file",
    "Diagram Type": "diagram_type",
    "Diagram Title": "diagram_title",
    "Label": "label",
}

DISPLAY_BASE = "https://example.org/gallery"


def flat_name(image_id: Column, path: Column) -> Column:
    """Anonymous file name from the id alone, so it needs no global counter."""
    tail = F.substring_index(path, "/", -1)
    suffix = F.when(
        F.instr(tail, ".") > 0, F.concat(F.lit("."), F.lower(F.substring_index(tail, ".", -1)))
    ).otherwise("")
    return F.format_string("diagram_%06d%s", image_id, suffix)


def export_rows(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Accepted items whose file exists, ready for both exports."""
    return (
        items.filter(F.col("status") == "labeled")
        .join(assets.select("source_image_path"), "source_image_path", "left_semi")
        .withColumn("image_file", flat_name(F.col("image_id"), F.col("source_image_path")))
    )


def export_view(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    types = dict(rows.dtypes)
    return rows.select(
        *[
            (scrub(F.col(c)) if types[c] == "string" else F.col(c)).alias(header)
            for header, c in columns.items()
        ]
    )


def write_exports(rows: DataFrame, folder: str) -> tuple[str, str]:
    """The same rows with and without their source."""
    paths = f"{folder}/with_source", f"{folder}/without_source"
    for path, columns in zip(paths, (WITH_SOURCE, WITHOUT_SOURCE)):
        export_view(rows, columns).write.parquet(path)
    return paths


def browse_view(images: DataFrame, base: str, names: dict[str, str]) -> DataFrame:
    """Flat browse export of uploaded crops."""
    return images.select(
        display_name(F.col("field"), names).alias("Field"),
        F.coalesce("caption", F.lit("")).alias("Caption"),
        F.col("page").alias("Page"),
        F.col("arxiv_id").alias("arXiv ID"),
        F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id").alias("arXiv URL"),
        F.concat(F.lit(base), F.lit("/v3/img/"), F.concat_ws("/", "field", "name")).alias("Image URL"),
        F.col("method").alias("Method"),
        F.bround(F.coalesce("p_diagram", F.lit(0.0)), 3).alias("P(diagram)"),
    )


def gallery_lines(images: DataFrame) -> DataFrame:
    """One JSON document per uploaded crop; readers sort by (category, name)."""
    url = F.concat_ws("/", F.lit("v3/img"), "field", "name")
    doc = F.struct(
        url.alias("url"), F.col("field").alias("category"), "arxiv_id", "page",
        F.coalesce("caption", F.lit("")).alias("caption"),
    )
    return images.filter(F.col("status") == "uploaded").select(
        F.col("field").alias("category"), "name", F.to_json(doc).alias("line")
    )


def gallery_header(images: DataFrame, base: str, target: int) -> DataFrame:
    """Head of the gallery: counts only, never the images themselves."""
    return images.agg(
        F.count_if(F.col("status").isin("local", "uploaded")).alias("count"),
        F.count_if(F.col("status") == "uploaded").alias("images"),
    ).select(F.lit(base).alias("base"), F.lit(target).cast("bigint").alias("target"), "count", "images")


def gallery_document(
    images: DataFrame, base: str, target: int, display: dict[str, str], start: float | None = None,
    updated_epoch: float | None = None, size: int = pieces.PIECE_BYTES,
) -> DataFrame:
    """The gallery as JSON documents of bounded bytes, in order of (category, name).

    Every document repeats the head (base, display names of categories, start,
    target, count, updated_epoch; a time not given is that of the call) and holds
    the images of one piece: a page of the gallery. All of them are the gallery.
    """
    placed = pieces.numbered(gallery_lines(images), ["category", "name"], "line", size)
    now = time.time()
    start, updated = (float(now if at is None else at) for at in (start, updated_epoch))
    names = F.from_json(F.lit(json.dumps(display)), "map<string,string>")
    head = images.agg(
        F.to_json(
            F.struct(
                F.lit(base).alias("base"), names.alias("display"), F.lit(start).alias("start"),
                F.lit(target).alias("target"),
                F.count_if(F.col("status").isin("local", "uploaded")).alias("count"),
                F.lit(updated).alias("updated_epoch"),
            )
        )
    ).scalar()
    # the lines are JSON already: they go into the document as they are
    body = placed.groupBy("piece").agg(
        F.count(F.lit(1)).alias("n"), pieces.joined(placed, "line", ",").alias("images")
    )
    whole = F.concat(F.rtrim(head, F.lit("}")), F.lit(',"images":['), "images", F.lit("]}"))
    return body.select("piece", "n", whole.alias("doc"))


def write_manifest(rows: DataFrame, path: str, order: list[str]) -> None:
    """Ordered manifest: globally range-partitioned files, each one sorted."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.csv(path, header=True)


def split_map_pieces(splits: DataFrame, seed: int, size: int = pieces.PIECE_BYTES) -> DataFrame:
    """The split map as JSON documents of bounded bytes, in order of the papers."""
    lines = splits.select("arxiv_id", "split", F.concat_ws(":", "arxiv_id", "split").alias("line"))
    entries = F.array_sort(F.collect_list(F.struct("arxiv_id", "split")))
    doc = F.struct(F.lit(seed).alias("seed"), F.map_from_entries(entries).alias("papers"))
    return pieces.numbered(lines, ["arxiv_id"], "line", size).groupBy("piece").agg(F.to_json(doc).alias("doc"))


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def latest_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Last result per experiment name."""
    rows = spark.read.schema(schema).parquet(path)
    body = F.struct(*[c for c in rows.columns if c != "name"])
    return rows.groupBy("name").agg(F.max_by(body, "timestamp").alias("r")).select("name", "r.*")


def manifest_hash(vectors: DataFrame, key: str = "image_id") -> str:
    """Order-free digest of which vectors there are and what they hold."""
    h = F.xxhash64(key, "embedding")
    r = vectors.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"),
        F.sum(F.pmod(h, F.lit(1 << 31))).alias("s"),
    ).first()
    return f"{r['n']}-{r['x']}-{r['s']}"


def cache_embeddings(
    vectors: DataFrame, path: str, model: str, force: bool = False, backbone: str = "",
    device: str = "",
) -> DataFrame:
    """Write unit vectors once and return the cache's one-row description: n,
    dim, min_dim, skipped (null or empty vectors), model, backbone, device and
    manifest_hash.

    The description is written after the vectors. A cache counts only if both
    are complete and the hash is that of ``vectors``; any other is written anew.
    """
    spark = vectors.sparkSession
    about, digest = f"{path}-about", manifest_hash(vectors)
    if not force:
        try:
            known = spark.read.parquet(about)
            known = known.where(F.col("manifest_hash") == digest).where(F.col("model") == model)
            spark.read.parquet(path).schema  # noqa: B018  fails where nothing is left
            if not known.isEmpty():
                return known
        except AnalysisException:  # not there or without files: not finished
            pass
    empty = F.col("embedding").isNull() | (F.size("embedding") == 0)
    unit = F.transform(unit_vector("embedding"), lambda x: x.cast("float"))
    # an old description must not outlive the vectors that it describes
    spark.createDataFrame([], "manifest_hash string, model string").write.mode("overwrite").parquet(about)
    vectors.filter(~empty).withColumn("embedding", unit).write.mode("overwrite").parquet(path)
    counted = spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"),
        F.min(F.size("embedding")).alias("min_dim"),
    )
    skipped = vectors.agg(F.count_if(empty).alias("skipped")).first()["skipped"]
    told = {"skipped": skipped, "model": model, "backbone": backbone, "device": device, "manifest_hash": digest}
    counted.withColumns({k: F.lit(v) for k, v in told.items()}).write.mode("overwrite").parquet(about)
    return spark.read.parquet(about)


def save_predictions(preds: DataFrame, path: str) -> None:
    """Prediction sets, one directory per model and split. Files are sized by
    the writer, so a model with most of the rows is written by many tasks."""
    cols = [c.split()[0] for c in schemas.PREDICTIONS.split(", ")]
    preds.select(*cols).write.mode("append").partitionBy("name", "split").parquet(path)


def write_archives(items: DataFrame, path: str) -> None:
    """Archive members laid out by category and batch."""
    items.write.partitionBy("field", "batch").parquet(path)

"""Sinks written to the shared folder and scans that read them back."""

from pyspark.sql import functions as F

from figureyard import schemas
from figureyard.functions import columns as c
from figureyard.functions.vectors import norm
from figureyard.operators import batching, datasets, evaluation
from figureyard.operators.datasets import SEED
from figureyard.operators.gates import box_gate
from figureyard.operators.ranking import id_bucket
from figureyard.plans.catalog import query
from figureyard.plans.curation import crops_with_split, splits
from figureyard.plans.registration import page_verdicts
from figureyard.session import shared_path
from figureyard.sinks import pieces, stores
from figureyard.sources import scans
from figureyard.sources import tables as t

DISPLAY = {"en": "English", "fr": "French"}


@query(
    "src1_feed_ingest",
    """
    SELECT arxiv_id, title, 'Abstract of ' || arxiv_id AS abstract, source || '; A. N. Other' AS authors,
           '2026-07-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS published,
           'http://feed.example/abs/' || arxiv_id AS abs_url,
           CASE WHEN doc_id % 3 = 0 THEN 'https://arxiv.org/pdf/' || arxiv_id
                ELSE 'http://feed.example/pdf/' || arxiv_id END AS pdf_url
    FROM (SELECT doc_id, arxiv_id, source,
                 trim(regexp_replace(regexp_replace(title, '[^A-Za-z0-9 \\n\\t.,]', '', 'g'), '\\s+', ' ', 'g')) AS title
          FROM papers_v)
    """,
)
def feed_ingest(spark, d):
    """Feed entries are written from the papers, then parsed back in bulk."""
    p = t.papers(spark, d)
    title = F.regexp_replace("title", r"[^A-Za-z0-9 \n\t.,]", "")
    link = F.when(
        F.col("doc_id") % 3 != 0,
        F.concat(F.lit('<link title="pdf" href="http://feed.example/pdf/'), "arxiv_id", F.lit('"/>')),
    ).otherwise('<link title="html" href="http://feed.example/x"/>')
    day = F.format_string("2026-07-%02d", F.col("doc_id") % 28 + 1)
    entry = F.concat(
        F.lit("<entry><id>http://feed.example/abs/"), "arxiv_id", F.lit("</id><title>"), title,
        F.lit("</title><summary> Abstract of "), "arxiv_id", F.lit("\n</summary><published>"), day,
        F.lit("T10:00:00Z</published><author><name>"), "source",
        F.lit("</name></author><author><name> A. N. Other</name></author>"), link, F.lit("</entry>"),
    )
    path = shared_path(spark, "feed")
    p.select(entry.alias("value")).write.text(path)
    lines = spark.read.option("lineSep", "</entry>\n").text(path)
    entries = lines.select(F.concat("value", F.lit("</entry>")).alias("xml"))
    return scans.parse_feed(entries, "xml").withColumn("authors", c.joined(F.col("authors")))


@query(
    "src2_crops_manifest",
    """
    SELECT c.image_id, c.path, c.cls, c.field, c.arxiv_id, c.source, s.split
    FROM crops_v c JOIN splits_v s ON s.arxiv_id = c.arxiv_id
    """,
)
def crops_manifest(spark, d):
    path = shared_path(spark, "crops-manifest")
    names = [x.split()[0] for x in schemas.CROPS_MANIFEST.split(", ")]
    stores.write_manifest(crops_with_split(spark, d).select(*names), path, ["image_id"])
    return scans.read_crops_manifest(spark, path)


@query(
    "src2_pages_manifest",
    """
    SELECT v.arxiv_id, v.page_no, CAST(v.has_diagram AS INT) AS has_diagram, v.field,
           v.field || '/' || v.arxiv_id || '.pdf' AS pdf_path, s.split
    FROM verdicts_v v JOIN splits_v s ON s.arxiv_id = v.arxiv_id
    """,
)
def pages_manifest(spark, d):
    path = shared_path(spark, "pages-manifest")
    pdf = F.concat("field", F.lit("/"), "arxiv_id", F.lit(".pdf"))
    rows = datasets.with_split(page_verdicts(spark, d), splits(spark, d)).select(
        "arxiv_id", "page_no", F.col("has_diagram").cast("int").alias("has_diagram"), "field",
        pdf.alias("pdf_path"), "split",
    )
    stores.write_manifest(rows, path, ["arxiv_id", "page_no"])
    return scans.read_pages_manifest(spark, path)


@query(
    "src3_gold_labels",
    """
    SELECT image_id, ['diagram', 'data_plot', 'photo', 'fragment_junk'][pred_a + 1] AS gold_cls,
           CASE WHEN pred_a = pred_b THEN 'rater_consensus' ELSE 'adjudicated' END AS source,
           CASE WHEN p_diagram BETWEEN 0.4 AND 0.6 THEN 1 ELSE 0 END AS uncertain, pred_a AS gold4
    FROM preds_v
    """,
)
def gold_labels(spark, d):
    path = shared_path(spark, "gold")
    p = t.predictions(spark, d)
    same = F.col("pred_a") == F.col("pred_b")
    p.select(
        "image_id", c.class_name(F.col("pred_a")).alias("gold_cls"),
        F.when(same, "rater_consensus").otherwise("adjudicated").alias("source"),
        F.col("p_diagram").between(0.4, 0.6).cast("int").alias("uncertain"),
        F.lit("").alias("note"),
    ).write.csv(path, header=True)
    return scans.read_gold(spark, path).drop("note")


@query(
    "src4_journal",
    """
    SELECT arxiv_id, page_no, has_diagram, page_no AS file_page, true AS readable FROM verdicts_v
    WHERE has_diagram AND (doc_id + page_no) % 11 <> 0
    UNION ALL
    SELECT NULL, NULL, NULL, page_no, false FROM verdicts_v WHERE (doc_id + page_no) % 11 = 0
    """,
)
def journal(spark, d):
    """A journal with damaged records: they are set aside, the rest is read."""
    path = shared_path(spark, "journal")
    v = page_verdicts(spark, d)
    record = F.to_json(F.struct("arxiv_id", "page_no", "has_diagram"))
    damaged = (F.col("doc_id") + F.col("page_no")) % 11 == 0
    v.select(
        F.when(damaged, F.concat(F.lit("{broken "), "arxiv_id")).otherwise(record).alias("value"),
        F.format_string("page_%03d", "page_no").alias("part"),
    ).write.partitionBy("part").text(path)
    good, bad = scans.read_journal(
        spark, f"{path}/part=*", "arxiv_id STRING, page_no INT, has_diagram BOOLEAN"
    )
    kept = good.filter("has_diagram").select(
        "arxiv_id", "page_no", "has_diagram", "file_page", F.lit(True).alias("readable")
    )
    lost = bad.select(
        F.lit(None).cast("string").alias("arxiv_id"), F.lit(None).cast("int").alias("page_no"),
        F.lit(None).cast("boolean").alias("has_diagram"),
        "file_page", F.lit(False).alias("readable"),
    )
    return kept.unionByName(lost)


@query(
    "src5_asset_listing",
    """
    SELECT source, sum(strlen(text) + 1)::BIGINT AS bytes, any_value(n) AS documents FROM documents
    JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source) GROUP BY source
    """,
)
def asset_listing(spark, d):
    """Texts written as assets of their source with side files beside them; the
    listing sees the assets only and is joined back to the documents."""
    docs = t.table(spark, d, "documents").filter(F.col("source").isNotNull())
    path = shared_path(spark, "assets")
    docs.select("source", "text").write.partitionBy("source").text(path)
    docs.select("source", "doc_id").write.mode("append").partitionBy("source").json(path)
    source = F.url_decode(F.regexp_extract("path", "/source=([^/]+)/", 1))
    listed = (
        scans.list_assets(spark, path, "*.txt")
        .groupBy(source.alias("source")).agg(F.sum("bytes").alias("bytes"))
    )
    return listed.join(docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents")), "source")


@query("src6_split_map", "SELECT arxiv_id, split FROM splits_v")
def split_map(spark, d):
    path = shared_path(spark, "split-map")
    stores.split_map_pieces(splits(spark, d), SEED).select("doc").write.text(path)
    docs = spark.read.schema("doc STRING").text(path)
    return scans.split_map_rows(docs, "doc")


@query(
    "src7_embeddings",
    """
    SELECT vec_id AS image_id, len(embedding) AS dim,
           round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 3) AS norm
    FROM embeddings
    """,
)
def embeddings(spark, d):
    return t.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.size("embedding").alias("dim"),
        F.round(norm(F.col("embedding")), 3).alias("norm"),
    )


def _prediction_sets(spark, d):
    p = t.predictions(spark, d)
    split = F.when(F.col("image_id") % 4 == 0, "val").otherwise("test")
    prob = F.array(
        F.col("p_diagram"), *[((1 - F.col("p_diagram")) / 3).alias(f"r{i}") for i in range(3)]
    )
    models = F.explode(
        F.array(
            F.struct(F.lit("model_a").alias("name"), F.col("pred_a").alias("pred4")),
            F.struct(F.lit("model_b").alias("name"), F.col("pred_b").alias("pred4")),
        )
    )
    return p.select("image_id", split.alias("split"), prob.alias("prob4"), models.alias("m")).select(
        "image_id", F.col("m.pred4").alias("pred4"), "prob4", F.col("m.name").alias("name"), "split"
    )


@query(
    "src8_prediction_scan",
    """
    SELECT image_id, pred_a AS pred4, round(p_diagram, 4) AS p FROM preds_v WHERE image_id % 4 = 0
    """,
)
def prediction_scan(spark, d):
    path = shared_path(spark, "preds")
    stores.save_predictions(_prediction_sets(spark, d), path)
    return scans.read_predictions(spark, path, "model_a", "val").select(
        "image_id", "pred4", F.round(F.get("prob4", 0), 4).alias("p")
    )


@query(
    "snk9_prediction_sets",
    """
    SELECT name, split, count(*) AS n, CAST(sum(pred4) AS BIGINT) AS pred_sum FROM (
      SELECT 'model_a' AS name, CASE WHEN image_id % 4 = 0 THEN 'val' ELSE 'test' END AS split, pred_a AS pred4 FROM preds_v
      UNION ALL SELECT 'model_b', CASE WHEN image_id % 4 = 0 THEN 'val' ELSE 'test' END, pred_b FROM preds_v)
    GROUP BY name, split
    """,
)
def prediction_sets(spark, d):
    path = shared_path(spark, "preds")
    stores.save_predictions(_prediction_sets(spark, d), path)
    return scans.read_predictions(spark, path).groupBy("name", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pred4").alias("pred_sum")
    )


def gallery_images(spark, d):
    status = (
        F.when(F.col("status") == "labeled", "uploaded")
        .when(F.col("status") == "pending", "local").otherwise("failed")
    )
    return t.images(spark, d).select(
        F.concat("arxiv_id", F.format_string("_%06d.png", "image_id")).alias("name"),
        "image_id", "arxiv_id", "field", F.col("page_no").cast("int").alias("page"),
        F.lit("image").alias("method"),
        ((F.col("image_id") * 37) % 1000 / F.lit(1000.0)).alias("p_diagram"),
        status.alias("status"),
        F.when(F.col("image_id") % 3 != 0, F.concat(F.lit("Figure "), F.col("image_id").cast("string"))).alias("caption"),
    )


_GALLERY = """
    g AS (SELECT arxiv_id || '_' || lpad(CAST(image_id AS VARCHAR), 6, '0') || '.png' AS name, image_id, arxiv_id, field,
                 page_no AS page, (image_id * 37) % 1000 / 1000::DOUBLE AS p_diagram,
                 CASE status WHEN 'labeled' THEN 'uploaded' WHEN 'pending' THEN 'local' ELSE 'failed' END AS status,
                 CASE WHEN image_id % 3 <> 0 THEN 'Figure ' || image_id END AS caption FROM images_v)
"""


@query(
    "src9_gallery_scan",
    f"""
    WITH {_GALLERY}
    SELECT 'v3/img/' || field || '/' || name AS key, field, CAST(page AS INT) AS page,
           coalesce(caption, '') AS caption, arxiv_id FROM g WHERE status = 'uploaded'
    """,
)
def gallery_scan(spark, d):
    path = shared_path(spark, "gallery")
    stores.gallery_lines(gallery_images(spark, d)).select("line").write.text(path)
    return scans.read_gallery(spark, path, lines=True)


@query(
    "src10_detector_boxes",
    """
    SELECT CAST(page_key AS VARCHAR) AS arxiv_id, 1 AS page_no, max(has_diagram) AS has_diagram,
           CAST(count(*) AS INT) AS n_boxes, round(sum(conf), 4) AS conf,
           max(CASE WHEN cls = 'figure' AND conf >= 0.4 AND (x1 - x0) * (y1 - y0) >= 0.03::DOUBLE * w * h THEN 1 ELSE 0 END) AS gate
    FROM boxes_v GROUP BY page_key
    """,
)
def detector_boxes(spark, d):
    """One entry per detected box, so no page has to meet in one task to be
    written; the entries of a page are put together by the aggregation."""
    xyxy = F.array(*[F.col(s).cast("double") for s in ("x0", "y0", "x1", "y1")])
    entry = F.struct(
        F.lit("val").alias("split"), "has_diagram", F.lit("f").alias("field"),
        F.array(F.struct("cls", "conf", xyxy.alias("xyxy"))).alias("boxes"),
        F.array(F.lit(t.PAGE_W), F.lit(t.PAGE_H)).alias("img_wh"),
    )
    key = F.concat(F.col("page_key").cast("string"), F.lit("|1"))
    path = shared_path(spark, "boxes")
    t.boxes(spark, d).select(F.to_json(F.create_map(key, entry)).alias("value")).write.text(path)
    rows = scans.detector_entries(spark.read.schema("value STRING").text(path), "value")
    return rows.groupBy("arxiv_id", "page_no").agg(
        F.max("has_diagram").alias("has_diagram"),
        F.sum(F.size("boxes")).cast("int").alias("n_boxes"),
        F.round(F.sum(F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b["conf"])), 4).alias("conf"),
        F.max(box_gate(F.col("boxes"), F.col("img_wh"), 0.4, 0.03)).alias("gate"),
    )


def _export_items(spark, d):
    i = t.images(spark, d)
    p = t.papers(spark, d).select(F.col("doc_id").alias("image_id"), "title", "source")
    path = F.concat(F.lit("images/"), "field", F.lit("/"), F.col("image_id").cast("string"), F.lit(".PNG"))
    aid = F.col("arxiv_id")
    return i.join(p, "image_id").select(
        "image_id", "status", c.display_name(F.col("field"), DISPLAY).alias("field"), "arxiv_id",
        F.col("title").alias("paper_title"), F.col("source").alias("authors"),
        F.lit("2026-07-16").alias("published"),
        F.concat(F.lit("https://arxiv.org/abs/"), aid).alias("abs_url"),
        F.concat(F.lit("https://arxiv.org/pdf/"), aid).alias("pdf_url"),
        F.col("page_no").alias("page_number"), path.alias("source_image_path"),
        F.lit("block diagram").alias("diagram_type"),
        F.concat(F.lit("Title "), F.col("image_id").cast("string")).alias("diagram_title"),
        F.concat(F.lit("Label\x01 "), F.col("width").cast("string")).alias("label"), "file_bytes",
    )


_EXPORT = """
    e AS (SELECT image_id, CASE i.field WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE i.field END AS shown,
                 i.arxiv_id, page_no, width, p.title, p.source,
                 'images/' || i.field || '/' || image_id || '.PNG' AS path,
                 'diagram_' || lpad(CAST(image_id AS VARCHAR), 6, '0') || '.png' AS flat
          FROM images_v i JOIN papers_v p ON p.doc_id = i.image_id
          WHERE i.status = 'labeled' AND file_bytes >= 1000)
"""


def _written_exports(spark, d):
    items = _export_items(spark, d)
    assets = items.filter(F.col("file_bytes") >= 1000).select("source_image_path")
    rows = stores.export_rows(items, assets)
    return stores.write_exports(rows, shared_path(spark, "export"))


@query(
    "snk1_export_attributed",
    f"""
    WITH {_EXPORT}
    SELECT shown AS "Field", arxiv_id AS "ArXiv ID",
           regexp_replace(title, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS "Paper Title", source AS "Authors",
           '2026-07-16' AS "Published", 'https://arxiv.org/abs/' || arxiv_id AS "Abstract URL",
           'https://arxiv.org/pdf/' || arxiv_id AS "PDF URL", page_no AS "Page", path AS "Source Image Path",
           flat AS "Image File", 'block diagram' AS "Diagram Type", 'Title ' || image_id AS "Diagram Title",
           'Label ' || width AS "Label" FROM e
    """,
)
def export_attributed(spark, d):
    return spark.read.parquet(_written_exports(spark, d)[0])


@query(
    "snk1_export_anonymised",
    f"""
    WITH {_EXPORT}
    SELECT shown AS "Field", flat AS "Image File", 'block diagram' AS "Diagram Type",
           'Title ' || image_id AS "Diagram Title", 'Label ' || width AS "Label" FROM e
    """,
)
def export_anonymised(spark, d):
    return spark.read.parquet(_written_exports(spark, d)[1])


@query(
    "snk2_flat_names",
    """
    SELECT image_id, 'diagram_' || lpad(CAST(image_id AS VARCHAR), 6, '0') || '.jpeg' AS flat
    FROM images_v WHERE status = 'labeled'
    """,
)
def flat_names(spark, d):
    path = F.concat("field", F.lit("/x.y/"), F.col("image_id").cast("string"), F.lit(".JPEG"))
    return t.images(spark, d).filter(F.col("status") == "labeled").select(
        "image_id", stores.flat_name(F.col("image_id"), path).alias("flat")
    )


ARCHIVE_CAP = 60_000


def _archives(spark, d):
    i = t.images(spark, d).select("field", "image_id", "file_bytes")
    return batching.size_capped_batches(
        i, "field", "image_id", "file_bytes", id_bucket(F.col("image_id"), 4096), ARCHIVE_CAP
    )


ARCHIVE_SQL = f"""
    WITH RECURSIVE o AS (SELECT field, image_id, file_bytes AS s,
                                row_number() OVER (PARTITION BY field ORDER BY image_id) AS rn FROM images_v),
      r AS (SELECT field, image_id, rn, s AS run, CAST(1 AS BIGINT) AS batch FROM o WHERE rn = 1
            UNION ALL
            SELECT o.field, o.image_id, o.rn,
                   CASE WHEN r.run >= {ARCHIVE_CAP} THEN o.s ELSE r.run + o.s END,
                   CASE WHEN r.run >= {ARCHIVE_CAP} THEN r.batch + 1 ELSE r.batch END
            FROM r JOIN o ON o.field = r.field AND o.rn = r.rn + 1)
    SELECT field, image_id, batch, 'v3/pdfs/' || field || '/batch_' || lpad(CAST(batch AS VARCHAR), 4, '0') || '.zip' AS archive
    FROM r
"""


@query("snk3_size_capped_archives", ARCHIVE_SQL)
def size_capped_archives(spark, d):
    batches, _ = _archives(spark, d)
    return batches.withColumn("archive", batching.archive_key(F.col("field"), F.col("batch")))


@query(
    "snk4_gallery_lines",
    f"""
    WITH {_GALLERY}
    SELECT field AS category, name, CAST(to_json(struct_pack(url := 'v3/img/' || field || '/' || name, category := field,
             arxiv_id := arxiv_id, page := CAST(page AS INT), caption := coalesce(caption, ''))) AS VARCHAR) AS line
    FROM g WHERE status = 'uploaded'
    """,
)
def gallery_lines(spark, d):
    return stores.gallery_lines(gallery_images(spark, d))


@query(
    "snk4_gallery_header",
    f"""
    WITH {_GALLERY}
    SELECT 'https://example.org/gallery' AS base, CAST(30000 AS BIGINT) AS target,
           count(*) FILTER (status IN ('local', 'uploaded')) AS count, count(*) FILTER (status = 'uploaded') AS images FROM g
    """,
)
def gallery_header(spark, d):
    return stores.gallery_header(gallery_images(spark, d), stores.DISPLAY_BASE, 30000)


@query(
    "snk5_browse_export",
    f"""
    WITH {_GALLERY}
    SELECT CASE field WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE field END AS "Field",
           coalesce(caption, '') AS "Caption", CAST(page AS INT) AS "Page", arxiv_id AS "arXiv ID",
           'https://arxiv.org/abs/' || arxiv_id AS "arXiv URL",
           'https://example.org/gallery/v3/img/' || field || '/' || name AS "Image URL", 'image' AS "Method",
           p_diagram AS "P(diagram)"
    FROM g WHERE status = 'uploaded'
    """,
)
def browse_export(spark, d):
    up = gallery_images(spark, d).filter(F.col("status") == "uploaded")
    return stores.browse_view(up, stores.DISPLAY_BASE, DISPLAY)


@query(
    "snk6_split_digest",
    """
    SELECT substr(sha256(string_agg(d, '' ORDER BY b)), 1, 16) AS manifest_sha, CAST(sum(n) AS BIGINT) AS papers FROM (
      SELECT substr(d, 1, 3) AS b, sha256(string_agg(d, '' ORDER BY d)) AS d, count(*) AS n FROM (
        SELECT sha256(arxiv_id || '|' || split) AS d FROM splits_v) GROUP BY 1)
    """,
)
def split_digest(spark, d):
    return datasets.split_digest(splits(spark, d))


# Fixed values of the two queries below: bytes of a piece, times of the gallery's head.
PIECE, START, UPDATED = 4096, 1234.5, 5678.25


@query(
    "snk6_manifest_tree",
    pieces.digest_sql("SELECT arxiv_id || '|' || split AS line, arxiv_id FROM splits_v", "arxiv_id", PIECE, 16),
)
def manifest_tree(spark, d):
    """Root of the hash tree over the ordered split map."""
    lines = splits(spark, d).select("arxiv_id", F.concat_ws("|", "arxiv_id", "split").alias("line"))
    return pieces.digest(pieces.numbered(lines, ["arxiv_id"], "line", PIECE), "line", 16)


@query(
    "snk4_gallery_pages",
    f"""
    WITH {_GALLERY},
      lines AS (SELECT field, name,
                  CAST(to_json(struct_pack(url := 'v3/img/' || field || '/' || name, category := field,
                    arxiv_id := arxiv_id, page := CAST(page AS INT), caption := coalesce(caption, ''))) AS VARCHAR) AS line
                FROM g WHERE status = 'uploaded'),
      placed AS (SELECT *, CAST(coalesce(sum(octet_length(encode(line))) OVER (ORDER BY field, name
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {PIECE} AS piece FROM lines)
    SELECT piece, count(*) AS n,
           '{{"base":"https://example.org/gallery","display":{{"en":"English","fr":"French"}},"start":{START},"target":30000,"count":'
           || (SELECT count(*) FROM g WHERE status IN ('local', 'uploaded')) || ',"updated_epoch":{UPDATED},"images":['
           || string_agg(line, ',' ORDER BY field, name) || ']}}' AS doc
    FROM placed GROUP BY piece
    """,
)
def gallery_pages(spark, d):
    return stores.gallery_document(
        gallery_images(spark, d), stores.DISPLAY_BASE, 30000, DISPLAY, START, UPDATED, PIECE
    )


@query(
    "snk7_results_ledger",
    """
    SELECT name, kind, round(acc, 4) AS acc, run FROM (
      SELECT model AS name, 'latency' AS kind, avg(ms) AS acc, 2 AS run FROM timings_v WHERE device = 'mps' GROUP BY model)
    """,
)
def results_ledger(spark, d):
    """Two runs append their rows; the later one is the current result."""
    path = shared_path(spark, "ledger")
    for run, device in ((1, "cpu"), (2, "mps")):
        rows = (
            t.timings(spark, d).filter(F.col("device") == device).groupBy("model")
            .agg(F.avg("ms").alias("acc"))
        )
        none = F.lit(None).cast("double")
        stores.append_results(
            rows.select(
                F.col("model").alias("name"), F.lit("latency").alias("kind"),
                F.create_map(F.lit("device"), F.lit(device)).alias("config"),
                F.struct("acc", none.alias("f1"), none.alias("precision"), none.alias("recall")).alias("val"),
                F.lit("").alias("manifest_sha"),
                F.timestamp_seconds(F.lit(run)).alias("timestamp"), F.lit("").alias("notes"),
            ),
            path,
        )
    return stores.latest_results(spark, path, schemas.RESULTS).select(
        "name", "kind", F.round("val.acc", 4).alias("acc"), F.unix_timestamp("timestamp").cast("int").alias("run")
    )


@query(
    "snk8_embedding_cache",
    """
    SELECT count(*) FILTER (vec_id % 10 > 0) AS n, max(len(embedding)) AS dim, min(len(embedding)) AS min_dim,
           count(*) FILTER (vec_id % 10 = 0) AS skipped, 'encoder' AS model, 'vit' AS backbone, 'cpu' AS device,
           true AS hashed
    FROM embeddings
    """,
)
def embedding_cache(spark, d):
    e = t.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.when(F.col("vec_id") % 10 > 0, F.col("embedding")).alias("embedding")
    )
    path = shared_path(spark, "embedding-cache")
    stores.cache_embeddings(e, path, "encoder", backbone="vit", device="cpu")
    # a second call finds the cache and leaves it alone
    told = stores.cache_embeddings(e, path, "encoder", backbone="vit", device="cpu")
    return told.withColumn("hashed", F.length("manifest_hash") > 2).drop("manifest_hash")


@query(
    "snk10_report_bundle",
    """
    SELECT to_json(struct_pack(
             leaderboard := (SELECT list(struct_pack(model := m, acc := printf('%.4f', a)) ORDER BY m) FROM (
                SELECT 'model_a' AS m, avg(CASE WHEN pred_a = y4 THEN 1.0::DOUBLE ELSE 0 END) AS a FROM preds_v
                UNION ALL SELECT 'model_b', avg(CASE WHEN pred_b = y4 THEN 1.0::DOUBLE ELSE 0 END) FROM preds_v)),
             speed := (SELECT list(struct_pack(model := model, n := n) ORDER BY model) FROM (
                SELECT model, count(*) AS n FROM timings_v GROUP BY model)),
             funnel := (SELECT list(struct_pack(stage := s, n := n) ORDER BY s) FROM (
                SELECT 'a_pages' AS s, count(*) AS n FROM verdicts_v
                UNION ALL SELECT 'b_diagram_pages', count(*) FROM verdicts_v WHERE has_diagram
                UNION ALL SELECT 'c_accepted', count(*) FROM images_v WHERE status = 'labeled'))))::VARCHAR AS document
    """,
)
def report_bundle(spark, d):
    """One JSON document from small result tables."""
    def listed(df, *cols):
        return df.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("a")).scalar()

    p = t.predictions(spark, d)
    models = p.select(
        F.inline(
            F.array(
                F.struct(F.lit("model_a").alias("model"), (F.col("pred_a") == F.col("y4")).alias("hit")),
                F.struct(F.lit("model_b").alias("model"), (F.col("pred_b") == F.col("y4")).alias("hit")),
            )
        )
    ).groupBy("model").agg(F.format_string("%.4f", F.avg(F.col("hit").cast("double"))).alias("acc"))
    speed = t.timings(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    v = page_verdicts(spark, d)
    pages = v.agg(F.count(F.lit(1)).alias("n"), F.count_if("has_diagram").alias("m"))
    accepted = t.images(spark, d).agg(F.count_if(F.col("status") == "labeled").alias("n"))
    funnel = pages.select(
        F.inline(
            F.array(
                F.struct(F.lit("a_pages").alias("stage"), F.col("n")),
                F.struct(F.lit("b_diagram_pages").alias("stage"), F.col("m").alias("n")),
            )
        )
    ).unionByName(accepted.select(F.lit("c_accepted").alias("stage"), "n"))
    doc = F.struct(
        listed(models, "model", "acc").alias("leaderboard"), listed(speed, "model", "n").alias("speed"),
        listed(funnel, "stage", "n").alias("funnel"),
    )
    return spark.range(1).select(F.to_json(doc).alias("document"))


@query(
    "src8_accuracy_of_saved_sets",
    """
    SELECT name, round_even(avg(CASE WHEN (pred4 = 0) = (y4 = 0) THEN 1.0::DOUBLE ELSE 0 END), 4) AS acc, count(*) AS n FROM (
      SELECT 'model_a' AS name, pred_a AS pred4, y4, image_id FROM preds_v UNION ALL SELECT 'model_b', pred_b, y4, image_id FROM preds_v)
    WHERE image_id % 4 <> 0 GROUP BY name
    """,
)
def accuracy_of_saved_sets(spark, d):
    path = shared_path(spark, "preds")
    stores.save_predictions(_prediction_sets(spark, d), path)
    saved = scans.read_predictions(spark, path, split="test").select("image_id", "name", "pred4")
    labels = t.predictions(spark, d).select("image_id", "y4")
    both = saved.join(labels, "image_id")
    return evaluation.binary_metrics(both, F.col("y4") == 0, F.col("pred4") == 0, ["name"]).select(
        "name", "acc", "n"
    )

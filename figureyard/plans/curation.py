"""Quality gates and dataset assembly queries."""

from pyspark.sql import functions as F

from figureyard.functions.columns import base_id, is_caption
from figureyard.functions import pixels
from figureyard.operators import datasets, gates, geometry
from figureyard.operators.ranking import id_bucket, rank_within
from figureyard.plans.catalog import query
from figureyard.plans.registration import page_verdicts
from figureyard.sources import tables as t

CAP = 50  # small enough to bind on the test tables


def crops(spark, d):
    path = F.concat(
        F.lit("images/"), "field", F.lit("/"), F.col("image_id").cast("string"), F.lit(".png")
    )
    return datasets.cap_trivial(datasets.silver_crops(t.images(spark, d), path), CAP)


def splits(spark, d):
    return datasets.assign_splits(datasets.paper_fields(crops(spark, d), t.pages(spark, d)))


def crops_with_split(spark, d):
    return datasets.with_split(crops(spark, d), splits(spark, d))


@query(
    "flt1_crop_shape_gate",
    """
    SELECT image_id, CASE WHEN file_bytes < 8192 THEN 'tiny-file'
                          WHEN width < 80 OR height < 80 THEN 'tiny-dims'
                          WHEN greatest(width, height) / greatest(1, least(width, height))::DOUBLE > 8 THEN 'extreme-aspect'
                          ELSE '' END AS reason
    FROM (SELECT *, file_bytes * 8 AS fb FROM images_v)
    """.replace("file_bytes < 8192", "fb < 8192"),
)
def crop_shape_gate(spark, d):
    i = t.images(spark, d)
    reason = gates.crop_reject_reason(
        F.col("file_bytes") * 8, F.lit(True), F.col("width"), F.col("height")
    )
    return i.select("image_id", reason.alias("reason"))


_BYTES = """
    WITH px AS (SELECT doc_id, n_chars, ('0x' || unnest(h))::INT AS v, generate_subscripts(h, 1) AS i FROM (
                  SELECT doc_id, n_chars, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents)),
         md AS (SELECT doc_id, arg_max(v, c * 1000 - v) AS m FROM (
                  SELECT doc_id, v, count(*) AS c FROM px GROUP BY doc_id, v) GROUP BY doc_id),
         st AS (SELECT px.doc_id, stddev_pop(v) AS std,
                       avg(CASE WHEN abs(v - m) > 16 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS content,
                       avg(CASE WHEN v > 240 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS light,
                       avg(CASE WHEN v < 32 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS dark,
                       count(DISTINCT CASE WHEN (i - 1) % 7 = 0 THEN v END) AS colors
                FROM px JOIN md ON md.doc_id = px.doc_id GROUP BY px.doc_id)
"""


def _pixels(spark, d):
    """Text bytes stand in for grey levels: real blobs of very different sizes."""
    docs = t.table(spark, d, "documents")
    stats = pixels.pixel_stats(F.encode("text", "UTF-8"), F.lit(64))
    return docs.select("doc_id", "n_chars", stats.alias("px"))


@query(
    "flt1_crop_pixel_gate",
    _BYTES
    + """
    SELECT d.doc_id, CASE WHEN d.n_chars * 8 < 8192 THEN 'tiny-file' WHEN std < 8 THEN 'near-blank'
                          WHEN content < 0.02 THEN 'low-content' ELSE '' END AS reason
    FROM documents d LEFT JOIN st ON st.doc_id = d.doc_id
    """,
)
def crop_pixel_gate(spark, d):
    reason = gates.crop_reject_reason(
        F.col("n_chars") * 8, F.lit(True), F.lit(500), F.lit(500),
        F.col("px.std"), F.col("px.content_frac"),
    )
    return _pixels(spark, d).select("doc_id", reason.alias("reason"))


@query(
    "flt2_crop_features",
    _BYTES
    + """
    , ed AS (SELECT doc_id,
                    coalesce(avg(abs(v - up)) FILTER (up IS NOT NULL), 0)
                    + coalesce(avg(abs(v - lf)) FILTER ((i - 1) % 64 > 0), 0) AS edge
             FROM (SELECT doc_id, i, v, lag(v, 64) OVER (PARTITION BY doc_id ORDER BY i) AS up,
                          lag(v) OVER (PARTITION BY doc_id ORDER BY i) AS lf,
                          count(*) OVER (PARTITION BY doc_id) AS n FROM px)
             WHERE i <= n // 64 * 64 GROUP BY doc_id)
    SELECT st.doc_id, d.n_chars AS bytes, 40 + st.doc_id % 900 AS width, 40 + (st.doc_id * 7) % 700 AS height,
           round(greatest(40 + st.doc_id % 900, 40 + (st.doc_id * 7) % 700)
                 / least(40 + st.doc_id % 900, 40 + (st.doc_id * 7) % 700)::DOUBLE, 4) AS aspect, round(std, 4) AS std, round(content, 4) AS content_frac,
           round(coalesce(edge, 0), 4) AS edge, CAST(colors AS INT) AS colors,
           round(light, 4) AS light_frac, round(dark, 4) AS dark_frac
    FROM st LEFT JOIN ed ON ed.doc_id = st.doc_id JOIN documents d ON d.doc_id = st.doc_id
    """,
)
def crop_features(spark, d):
    rows = _pixels(spark, d).where(F.col("n_chars") > 0)
    width, height = 40 + F.col("doc_id") % 900, 40 + (F.col("doc_id") * 7) % 700
    found = pixels.crop_features(F.col("n_chars"), width, height, F.col("px"))
    whole = ("bytes", "width", "height", "colors")
    return rows.select(
        "doc_id", *[(c if n in whole else F.round(c, 4)).alias(n) for n, c in found.items()]
    )


@query(
    "flt3_silver_class",
    """
    SELECT image_id,
           CASE WHEN status = 'labeled' THEN 'diagram' WHEN reject_reason LIKE 'local:%' THEN 'fragment_junk'
                WHEN reject_reason LIKE '%plot%' OR reject_reason LIKE '%heatmap%' THEN 'data_plot'
                WHEN reject_reason LIKE '%photo%' THEN 'photo' ELSE 'fragment_junk' END AS cls,
           CASE WHEN status = 'labeled' THEN 'accepted' WHEN reject_reason LIKE 'local:%' THEN 'local'
                ELSE 'llm' END AS source
    FROM images_v WHERE status IN ('labeled', 'rejected')
    """,
)
def silver_class(spark, d):
    return datasets.silver_crops(t.images(spark, d), F.lit("")).select("image_id", "cls", "source")


@query(
    "flt4_detector_gate",
    """
    SELECT page_key, max(CASE WHEN cls = 'figure' AND conf >= 0.4
                               AND (x1 - x0) * (y1 - y0) >= 0.03::DOUBLE * w * h THEN 1 ELSE 0 END) AS gate
    FROM boxes_v GROUP BY page_key
    """,
)
def detector_gate(spark, d):
    b = t.boxes(spark, d)
    big = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= F.lit(0.03) * F.col("w") * F.col("h")
    hit = (F.col("cls") == "figure") & (F.col("conf") >= 0.4) & big
    return b.groupBy("page_key").agg(F.max(hit.cast("int")).alias("gate"))


_CANDIDATES = """
    (SELECT *, (x1 - x0) * (y1 - y0) / (612 * 792)::DOUBLE AS af FROM (
       SELECT page_key, kind, greatest(x0, 0) AS x0, greatest(y0, 0) AS y0, least(x1, 612) AS x1,
              least(y1, 792) AS y1
       FROM rects_v WHERE kind <> 'vector' OR (x1 - x0 > 3 AND y1 - y0 > 3))
     WHERE (x1 - x0) * (y1 - y0) / (612 * 792)::DOUBLE BETWEEN 0.03 AND 0.92
       AND x1 - x0 > 55 AND y1 - y0 > 55
       AND greatest(x1 - x0, y1 - y0) / greatest(1, least(x1 - x0, y1 - y0))::DOUBLE <= 6)
"""


def candidates(spark, d):
    return geometry.figure_candidates(t.rects(spark, d), F.lit(t.PAGE_W), F.lit(t.PAGE_H))


@query(
    "flt5_figure_candidates",
    f"SELECT page_key, kind, x0, y0, x1, y1, round(af, 6) AS area_frac FROM {_CANDIDATES}",
)
def figure_candidates(spark, d):
    return candidates(spark, d).withColumn("area_frac", F.round("area_frac", 6))


@query(
    "flt6_no_graphics",
    """
    SELECT o_orderkey AS page_key FROM orders
    WHERE o_orderkey NOT IN (SELECT page_key FROM rects_v)
    """,
)
def no_graphics(spark, d):
    pages = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("page_key"))
    graphics = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_key"))
    return gates.pages_without_graphics(pages, graphics, ["page_key"])


@query(
    "flt7_facet_page",
    """
    SELECT field, image_id, pos FROM (
      SELECT field, image_id, row_number() OVER (PARTITION BY field ORDER BY image_id) AS pos FROM images_v)
    WHERE pos > 60 AND pos <= 120
    """,
)
def facet_page(spark, d):
    i = t.images(spark, d).select("field", "image_id")
    return gates.facet_page(i, "field", "image_id", 2)


@query(
    "flt8_caption_pages",
    """
    SELECT page_key, bool_or(regexp_matches(txt, '(?i)^\\s*fig(?:ure)?\\.?\\s*\\d+')) AS has_captions
    FROM blocks_v GROUP BY page_key
    """,
)
def caption_pages(spark, d):
    b = t.blocks(spark, d)
    return b.groupBy("page_key").agg(F.max(is_caption(F.col("txt"))).alias("has_captions"))


@query("wn1_paper_splits", "SELECT arxiv_id, field, split FROM splits_v")
def paper_splits(spark, d):
    return splits(spark, d)


@query("wn2_capped_negatives", "SELECT image_id, cls, source FROM crops_v")
def capped_negatives(spark, d):
    return crops(spark, d).select("image_id", "cls", "source")


@query(
    "wn3_seeded_sample",
    "SELECT vec_id AS image_id FROM embeddings ORDER BY md5('20260716|' || vec_id), vec_id LIMIT 128",
)
def seeded_sample(spark, d):
    e = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"))
    return datasets.seeded_sample(e, "image_id", 128)


@query(
    "wn3_repeated_sample",
    """
    WITH s AS (SELECT conv_id, row_number() OVER (ORDER BY md5('20260716|' || conv_id), conv_id) - 1 AS i,
                      count(*) OVER () AS n
               FROM (SELECT DISTINCT conv_id FROM conversations)
               ORDER BY md5('20260716|' || conv_id), conv_id LIMIT 512)
    SELECT CAST(p AS INT) AS pos, conv_id FROM range(0, 512) r(p)
    JOIN s ON s.i = p % (SELECT least(max(n), 512) FROM s)
    """,
)
def repeated_sample(spark, d):
    c = t.table(spark, d, "conversations").select("conv_id").distinct()
    return datasets.repeated_sample(c, "conv_id", 512)


@query(
    "wn9_rating_lists",
    """
    WITH s AS (SELECT image_id, path FROM crops_v c JOIN splits_v s ON s.arxiv_id = c.arxiv_id
               WHERE split = 'test' ORDER BY md5('20260716|' || image_id), image_id LIMIT 40)
    SELECT rater, image_id, path, md5(rater || '|' || image_id) AS sort_key
    FROM s, (VALUES ('a'), ('b')) r(rater)
    """,
)
def rating_lists(spark, d):
    return datasets.rating_lists(crops_with_split(spark, d), 40, ["a", "b"])


@query(
    "ag7_class_by_split",
    """
    SELECT cls, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
           count(*) FILTER (split = 'test') AS test
    FROM crops_v c JOIN splits_v s ON s.arxiv_id = c.arxiv_id GROUP BY cls
    """,
)
def class_by_split(spark, d):
    return datasets.class_by_split(crops_with_split(spark, d))


@query(
    "ag7_pages_by_split",
    """
    SELECT has_diagram, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
           count(*) FILTER (split = 'test') AS test
    FROM verdicts_v v JOIN splits_v s ON s.arxiv_id = v.arxiv_id GROUP BY has_diagram
    """,
)
def pages_by_split(spark, d):
    # count pages per paper first: the split joins one row per paper
    per_paper = page_verdicts(spark, d).groupBy("arxiv_id", "has_diagram").agg(
        F.count(F.lit(1)).alias("n")
    )
    joined = datasets.with_split(per_paper, splits(spark, d))
    return joined.groupBy("has_diagram").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(s)
            for s in ("train", "val", "test")
        ]
    )


@query(
    "ag15_class_weights",
    """
    SELECT y4, n_c, round(n / (4 * n_c)::DOUBLE, 6) AS balanced, round(sqrt(n / n_c::DOUBLE), 6) AS inv_sqrt
    FROM (SELECT y4, count(*) AS n_c FROM preds_v GROUP BY y4), (SELECT count(*) AS n FROM preds_v)
    """,
)
def class_weights(spark, d):
    return datasets.class_weights(t.predictions(spark, d)).select(
        "y4", "n_c", F.round("balanced", 6).alias("balanced"), F.round("inv_sqrt", 6).alias("inv_sqrt")
    )


@query(
    "ag18_split_check",
    """
    SELECT count(*) AS rows, count(DISTINCT arxiv_id) AS papers, 0 AS violations FROM (
      SELECT c.arxiv_id, split FROM crops_v c JOIN splits_v s ON s.arxiv_id = c.arxiv_id
      UNION ALL
      SELECT g.arxiv_id, split FROM pages_v g JOIN splits_v s ON s.arxiv_id = g.arxiv_id)
    """,
)
def split_check(spark, d):
    s = splits(spark, d)
    rows = datasets.with_split(
        crops(spark, d).select("arxiv_id").unionByName(t.pages(spark, d).select("arxiv_id")), s
    )
    per_paper = rows.groupBy("arxiv_id").agg(
        F.count(F.lit(1)).alias("n"), (F.min("split") != F.max("split")).cast("int").alias("bad")
    )
    return per_paper.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("papers"), F.sum("bad").alias("violations")
    )


@query(
    "ag18_distinct_pending_fields",
    "SELECT DISTINCT field, source FROM papers_v WHERE status = 'pending'",
)
def distinct_pending_fields(spark, d):
    return t.papers(spark, d).filter(F.col("status") == "pending").select("field", "source").distinct()


@query(
    "wn6_crop_ordinals",
    """
    SELECT image_id, arxiv_id, page_no,
           row_number() OVER (PARTITION BY base_id, page_no ORDER BY image_id) AS ordinal
    FROM (SELECT *, regexp_replace(arxiv_id, 'v[0-9]+$', '') AS base_id FROM images_v)
    """,
)
def crop_ordinals(spark, d):
    i = t.images(spark, d).select(
        "image_id", "arxiv_id", "page_no", base_id(F.col("arxiv_id")).alias("base_id")
    )
    key = F.col("image_id")
    return rank_within(i, ["base_id", "page_no"], [key], [id_bucket(key)], "ordinal").drop("base_id")

"""Orders, limits and set operations."""

from pyspark.sql import functions as F

from figureyard.operators import delivery
from figureyard.plans.catalog import query
from figureyard.plans.curation import crops
from figureyard.plans.joining import positioned_manifest
from figureyard.plans.registration import page_verdicts
from figureyard.sources import tables as t


@query(
    "sr1_first_labeled",
    """
    SELECT image_id, field FROM images_v WHERE status = 'labeled' ORDER BY field, image_id LIMIT 100
    """,
)
def first_labeled(spark, d):
    labeled = t.images(spark, d).filter(F.col("status") == "labeled").select("image_id", "field")
    return labeled.orderBy("field", "image_id").limit(100)


@query(
    "sr1_largest_rects",
    """
    SELECT page_key, kind, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area FROM rects_v
    ORDER BY area DESC, page_key, kind, x0, y0, x1, y1 LIMIT 200
    """,
)
def largest_rects(spark, d):
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    r = t.rects(spark, d).withColumn("area", size)
    return r.orderBy(F.desc("area"), "page_key", "kind", "x0", "y0", "x1", "y1").limit(200)


@query(
    "sr2_first_pending",
    "SELECT arxiv_id, field FROM papers_v WHERE status = 'pending' ORDER BY arxiv_id LIMIT 1",
)
def first_pending(spark, d):
    p = t.papers(spark, d).filter(F.col("status") == "pending").select("arxiv_id", "field")
    return p.orderBy("arxiv_id").limit(1)


_POSITIONS = """
    m AS (SELECT field, image_id, row_number() OVER (ORDER BY field, image_id) AS pos FROM images_v)
"""


@query(
    "sr3_next_items_per_user",
    f"""
    WITH {_POSITIONS}
    SELECT uid, image_id, pos, rn FROM (
      SELECT u.uid, m.image_id, m.pos, row_number() OVER (PARTITION BY u.uid ORDER BY m.pos) AS rn
      FROM (SELECT DISTINCT user_id AS uid FROM events) u, m
      WHERE NOT EXISTS (SELECT 1 FROM downloads_v x WHERE x.uid = u.uid AND x.image_id = m.image_id))
    WHERE rn <= 200
    """,
)
def next_items_per_user(spark, d):
    users = t.table(spark, d, "events").select(F.col("user_id").alias("uid"))
    out = delivery.pending_items(positioned_manifest(spark, d), users, t.downloads(spark, d))
    return out.select("uid", "image_id", "pos", "rn")


@query(
    "str8_delivery_totals",
    """
    SELECT uid, total, count(*) AS downloaded, total - count(*) AS pending,
           total - count(*) FILTER (m.image_id IS NOT NULL) AS pending_exact
    FROM downloads_v x LEFT JOIN images_v m ON m.image_id = x.image_id,
         (SELECT count(*) AS total FROM images_v) GROUP BY uid, total
    """,
)
def delivery_totals(spark, d):
    return delivery.delivery_totals(t.images(spark, d).select("image_id"), t.downloads(spark, d))


@query(
    "st1_cost_rows",
    """
    SELECT arxiv_id, page_no, 'screen' AS judge, screen_cost AS cost FROM pages_v WHERE has_graphics
    UNION ALL SELECT arxiv_id, page_no, 'confirm', confirm_cost FROM pages_v WHERE has_graphics AND screen_pos
    """,
)
def cost_rows(spark, d):
    g = t.pages(spark, d).filter("has_graphics")
    screen = g.select("arxiv_id", "page_no", F.lit("screen").alias("judge"), F.col("screen_cost").alias("cost"))
    confirm = g.filter("screen_pos").select(
        "arxiv_id", "page_no", F.lit("confirm").alias("judge"), F.col("confirm_cost").alias("cost")
    )
    return screen.unionByName(confirm)


@query(
    "st2_common_ids",
    """
    SELECT image_id FROM preds_v INTERSECT SELECT doc_id FROM labels
    INTERSECT SELECT image_id FROM images_v WHERE status = 'labeled'
    """,
)
def common_ids(spark, d):
    labeled = t.images(spark, d).filter(F.col("status") == "labeled").select("image_id")
    labels = t.table(spark, d, "labels").select(F.col("doc_id").alias("image_id"))
    return t.predictions(spark, d).select("image_id").intersect(labels).intersect(labeled)


@query(
    "st3_undelivered",
    "SELECT image_id FROM images_v EXCEPT SELECT image_id FROM downloads_v",
)
def undelivered(spark, d):
    return t.images(spark, d).select("image_id").subtract(t.downloads(spark, d).select("image_id"))


@query(
    "st3_pages_not_positive",
    """
    SELECT arxiv_id, page_no FROM pages_v EXCEPT ALL SELECT arxiv_id, page_no FROM verdicts_v WHERE has_diagram
    """,
)
def pages_not_positive(spark, d):
    keys = ["arxiv_id", "page_no"]
    return t.pages(spark, d).select(*keys).exceptAll(
        page_verdicts(spark, d).filter("has_diagram").select(*keys)
    )


@query("st4_distinct_classes", "SELECT DISTINCT field, cls, source FROM crops_v")
def distinct_classes(spark, d):
    return crops(spark, d).select("field", "cls", "source").distinct()

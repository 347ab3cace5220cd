"""Join queries: parents, derived tables, geometry, deliveries and judges."""

from pyspark.sql import functions as F

from figureyard.functions.columns import is_caption
from figureyard.operators import delivery, evaluation, geometry, models, reports
from figureyard.operators.ranking import id_bucket, rank_within
from figureyard.plans.catalog import query
from figureyard.plans.curation import _CANDIDATES, candidates, crops_with_split
from figureyard.plans.registration import page_verdicts
from figureyard.sources import tables as t


@query(
    "jn1_images_with_papers",
    """
    SELECT i.image_id, i.arxiv_id, p.title, p.field FROM images_v i
    JOIN papers_v p ON p.arxiv_id = i.arxiv_id WHERE i.status = 'labeled'
    """,
)
def images_with_papers(spark, d):
    i = t.images(spark, d).filter(F.col("status") == "labeled").select("image_id", "arxiv_id")
    return i.join(t.papers(spark, d).select("arxiv_id", "title", "field"), "arxiv_id")


@query(
    "jn2_images_pages_papers",
    """
    SELECT i.image_id, i.arxiv_id, i.page_no, g.screen_pos, p.source FROM images_v i
    JOIN pages_v g ON g.arxiv_id = i.arxiv_id AND g.page_no = i.page_no
    JOIN papers_v p ON p.arxiv_id = i.arxiv_id
    """,
)
def images_pages_papers(spark, d):
    i = t.images(spark, d).select("image_id", "arxiv_id", "page_no")
    g = t.pages(spark, d).select("arxiv_id", "page_no", "screen_pos")
    p = t.papers(spark, d).select("arxiv_id", "source")
    return i.join(g, ["arxiv_id", "page_no"]).join(p, "arxiv_id")


@query(
    "jn3_papers_of_least_downloaded_field",
    """
    SELECT p.arxiv_id, p.field FROM papers_v p JOIN (
      SELECT field FROM papers_v GROUP BY field HAVING count(*) FILTER (status = 'pending') > 0
      ORDER BY count(*) FILTER (status = 'downloaded'), field LIMIT 1) f ON f.field = p.field
    WHERE p.status = 'pending'
    """,
)
def papers_of_least_downloaded_field(spark, d):
    p = t.papers(spark, d).select("arxiv_id", "field", "status")
    pick = reports.least_served(p).select("field")
    return p.filter(F.col("status") == "pending").join(pick, "field").select("arxiv_id", "field")


@query(
    "jn4_papers_of_least_accepted_field",
    """
    SELECT p.arxiv_id, p.field FROM papers_v p JOIN (
      SELECT f.field FROM (SELECT DISTINCT field FROM papers_v WHERE status = 'pending') f
      LEFT JOIN (SELECT field, count(*) AS n FROM images_v WHERE status = 'labeled' GROUP BY field) i
        ON i.field = f.field
      ORDER BY coalesce(i.n, 0), f.field LIMIT 1) f ON f.field = p.field
    WHERE p.status = 'pending'
    """,
)
def papers_of_least_accepted_field(spark, d):
    p = t.papers(spark, d).select("arxiv_id", "field", "status")
    accepted = t.images(spark, d).filter(F.col("status") == "labeled")
    pick = reports.least_served(p, accepted).select("field")
    return p.filter(F.col("status") == "pending").join(pick, "field").select("arxiv_id", "field")


@query(
    "jn5_manifest_with_embeddings",
    """
    SELECT c.image_id, c.cls, s.split, len(e.embedding) AS dim
    FROM crops_v c JOIN splits_v s ON s.arxiv_id = c.arxiv_id JOIN embeddings e ON e.vec_id = c.image_id
    """,
)
def manifest_with_embeddings(spark, d):
    e = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")
    return models.aligned(crops_with_split(spark, d), e).select(
        "image_id", "cls", "split", F.size("embedding").alias("dim")
    )


@query(
    "jn6_predictions_with_labels",
    """
    SELECT p.image_id, p.pred_a, l.quality FROM preds_v p JOIN labels l ON l.doc_id = p.image_id
    """,
)
def predictions_with_labels(spark, d):
    p = t.predictions(spark, d).select("image_id", "pred_a")
    labels = t.table(spark, d, "labels").select(F.col("doc_id").alias("image_id"), "quality")
    return p.join(labels, "image_id")


@query(
    "jn7_labels_with_two_predictions",
    """
    SELECT image_id, y4 = pred_a AS ok_a, y4 = pred_b AS ok_b FROM preds_v
    """,
)
def labels_with_two_predictions(spark, d):
    p = t.predictions(spark, d)
    labels = p.select("image_id", "y4")
    return (
        labels.join(p.select("image_id", "pred_a"), "image_id")
        .join(p.select("image_id", "pred_b"), "image_id")
        .select(
            "image_id", (F.col("y4") == F.col("pred_a")).alias("ok_a"),
            (F.col("y4") == F.col("pred_b")).alias("ok_b"),
        )
    )


@query(
    "jn8_gold_pages",
    """
    SELECT v.arxiv_id, v.page_no, v.has_diagram FROM verdicts_v v
    WHERE EXISTS (SELECT 1 FROM images_v i WHERE i.arxiv_id = v.arxiv_id AND i.page_no = v.page_no
                  AND i.toxic IS NOT NULL)
    """,
)
def gold_pages(spark, d):
    gold = t.images(spark, d).filter(F.col("toxic").isNotNull()).select("arxiv_id", "page_no")
    return page_verdicts(spark, d).select("arxiv_id", "page_no", "has_diagram").join(
        gold, ["arxiv_id", "page_no"], "left_semi"
    )


def positioned_manifest(spark, d):
    """All crops in (field, id) order with their position."""
    i = t.images(spark, d).select("field", "image_id")
    key = F.col("image_id")
    return rank_within(i, [], [F.col("field"), key], [F.col("field"), id_bucket(key)], "pos")


@query(
    "jn9_pending_per_user",
    """
    SELECT uid, count(*) AS pending FROM (
      SELECT u.uid, m.image_id FROM (SELECT DISTINCT uid FROM downloads_v) u, images_v m
      EXCEPT SELECT uid, image_id FROM downloads_v) GROUP BY uid
    """,
)
def pending_per_user(spark, d):
    totals = delivery.delivery_totals(t.images(spark, d).select("image_id"), t.downloads(spark, d))
    return totals.filter(F.col("pending_exact") > 0).select(
        "uid", F.col("pending_exact").alias("pending")
    )


@query(
    "jn10_flagged_manifest",
    """
    SELECT m.image_id, m.field, x.image_id IS NOT NULL AS downloaded FROM images_v m
    LEFT JOIN (SELECT DISTINCT image_id FROM downloads_v
               WHERE uid = (SELECT min(uid) FROM downloads_v)) x
      ON x.image_id = m.image_id
    """,
)
def flagged_manifest(spark, d):
    got = t.downloads(spark, d)
    user = got.agg(F.min("uid")).scalar()
    return delivery.flagged_manifest(
        t.images(spark, d).select("image_id", "field"), got.filter(F.col("uid") == user)
    )


_OVERLAP = """
    CASE WHEN least(a.x1, b.x1) <= greatest(a.x0, b.x0) OR least(a.y1, b.y1) <= greatest(a.y0, b.y0) THEN 0
         ELSE (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))
              / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))::DOUBLE END
"""


@query(
    "jn11_vector_rects_not_in_images",
    f"""
    SELECT a.page_key, a.x0, a.y0, a.x1, a.y1 FROM rects_v a
    WHERE a.kind = 'vector' AND NOT EXISTS (
      SELECT 1 FROM rects_v b WHERE b.page_key = a.page_key AND b.kind = 'image' AND {_OVERLAP} > 0.6)
    """,
)
def vector_rects_not_in_images(spark, d):
    r = t.rects(spark, d)
    sides = ["page_key", *geometry.SIDES]
    vector = r.filter(F.col("kind") == "vector").select(*sides)
    return geometry.not_covered(vector, r.filter(F.col("kind") == "image"), "page_key")


def _caption_sql(figures: str) -> str:
    return f"""
    WITH RECURSIVE f AS (SELECT DISTINCT page_key, x0, y0, x1, y1 FROM {figures}),
         below AS (SELECT f.*, b.by0, b.txt,
                          row_number() OVER (PARTITION BY f.page_key, f.x0, f.y0, f.x1, f.y1 ORDER BY b.by0, b.txt) AS rn,
                          lead(b.txt) OVER (PARTITION BY f.page_key, f.x0, f.y0, f.x1, f.y1 ORDER BY b.by0, b.txt) AS nxt,
                          regexp_matches(b.txt, '(?i)^(fig(ure)?|table|scheme)\\b') AS cap
                   FROM f JOIN (SELECT DISTINCT page_key, bx0, bx1, by0, txt FROM blocks_v) b
                     ON b.page_key = f.page_key AND b.by0 BETWEEN f.y1 - 3 AND f.y1 + 260
                    AND b.bx1 >= f.x0 AND b.bx0 <= f.x1),
         pick AS (SELECT page_key, x0, y0, x1, y1,
                         arg_min(CASE WHEN cap THEN txt || coalesce(' ' || nxt, '') ELSE txt END,
                                 CASE WHEN cap THEN rn ELSE rn + 1000000 END) AS caption
                  FROM below GROUP BY page_key, x0, y0, x1, y1)
    SELECT f.page_key, f.x0, f.y0, f.x1, f.y1,
           substr(coalesce(trim(regexp_replace(caption, '\\s+', ' ', 'g')), ''), 1, 800) AS caption
    FROM f LEFT JOIN pick p ON p.page_key = f.page_key AND p.x0 = f.x0 AND p.y0 = f.y0 AND p.x1 = f.x1 AND p.y1 = f.y1
    """


@query("jn12_captions", _caption_sql("rects_v"))
def captions(spark, d):
    return geometry.captions(t.drawn(spark, d), t.blocks(spark, d), "page_key")


@query(
    "jn13_adjudicated_labels",
    """
    SELECT image_id, pred_a AS rater_a, pred_b AS rater_b,
           CASE WHEN pred_a = pred_b THEN pred_a ELSE y4 END AS gold4,
           CASE WHEN pred_a = pred_b THEN 'rater_consensus' ELSE 'adjudicated' END AS source
    FROM preds_v
    """,
)
def adjudicated_labels(spark, d):
    p = t.predictions(spark, d)
    a = p.select("image_id", F.col("pred_a").alias("rater_a"))
    b = p.select("image_id", F.col("pred_b").alias("rater_b"))
    judged = p.filter(F.col("pred_a") != F.col("pred_b")).select("image_id", "y4")
    both = a.join(b, "image_id").join(judged, "image_id", "left")
    same = F.col("rater_a") == F.col("rater_b")
    return both.select(
        "image_id", "rater_a", "rater_b",
        F.when(same, F.col("rater_a")).otherwise(F.col("y4")).alias("gold4"),
        F.when(same, "rater_consensus").otherwise("adjudicated").alias("source"),
    )


@query(
    "jn14_silver_and_gold",
    """
    SELECT field, round(avg(CASE WHEN pred_a = y4 THEN 1.0::DOUBLE ELSE 0 END), 4) AS silver_acc,
           round(avg(CASE WHEN pred_a = pred_b THEN 1.0::DOUBLE ELSE 0 END), 4) AS gold_acc
    FROM preds_v GROUP BY field
    """,
)
def silver_and_gold(spark, d):
    p = t.predictions(spark, d)

    def acc(truth, name):
        hit = (F.col("pred_a") == F.col(truth)).cast("double")
        return p.groupBy("field").agg(F.round(F.avg(hit), 4).alias(name))

    return acc("y4", "silver_acc").join(acc("pred_b", "gold_acc"), "field")


@query(
    "jn15_queue_without_in_flight",
    """
    SELECT seq, entity FROM decisions_v d WHERE status = 'pending'
      AND NOT EXISTS (SELECT 1 FROM downloads_v x WHERE x.uid = d.entity AND x.image_id = d.seq % 200)
    """,
)
def queue_without_in_flight(spark, d):
    waiting = t.decisions(spark, d).filter(F.col("status") == "pending").select(
        "seq", "entity", (F.col("seq") % 200).alias("image_id")
    )
    flying = t.downloads(spark, d).withColumnRenamed("uid", "entity")
    return waiting.join(flying, ["entity", "image_id"], "left_anti").select("seq", "entity")


_GRID = "(SELECT i, i / 100::DOUBLE AS v FROM range(5, 100, 5) g(i))"


@query(
    "jn16_threshold_grid",
    f"""
    SELECT g.v AS threshold, count(*) FILTER (p_diagram >= g.v) AS accepted,
           count(*) FILTER (p_diagram >= g.v AND y4 = 0) AS accepted_pos
    FROM preds_v, {_GRID} g GROUP BY g.v
    """,
)
def threshold_grid(spark, d):
    # scores are counted per grid cell first, so rows never meet the grid
    p = t.predictions(spark, d)
    points = evaluation.grid_points()
    edges = F.array(*[F.lit(v) for v in points])
    passed = F.size(F.filter(edges, lambda e: e <= F.col("p_diagram")))
    hist = p.groupBy(passed.alias("passed")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y4") == 0).alias("pos")
    )
    reached = hist.filter(F.col("passed") > 0).select(
        F.explode(F.slice(edges, F.lit(1), F.col("passed"))).alias("threshold"), "n", "pos"
    )
    grid = spark.range(1).select(F.explode(edges).alias("threshold"))
    sums = reached.groupBy("threshold").agg(
        F.sum("n").alias("accepted"), F.sum("pos").alias("accepted_pos")
    )
    return grid.join(sums, "threshold", "left").na.fill(0, ["accepted", "accepted_pos"])


_CENTROID = """
    u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
                 sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings),
    m AS (SELECT label, j, avg(e[j] / CASE WHEN n = 0 THEN 1 ELSE n END) AS m
          FROM u, range(1, 65) r(j) GROUP BY label, j),
    cn AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label),
    sc AS (SELECT u.vec_id, m.label, sum(u.e[m.j] * m.m) / any_value(CASE WHEN cn.n = 0 THEN 1 ELSE cn.n END)
                    / any_value(CASE WHEN u.n = 0 THEN 1 ELSE u.n END) AS s
           FROM u, m JOIN cn ON cn.label = m.label GROUP BY u.vec_id, m.label)
"""


@query(
    "jn17_nearest_centroid",
    f"""
    WITH {_CENTROID}
    SELECT vec_id, arg_max(label, s) AS pred, round(max(s), 4) AS score FROM sc GROUP BY vec_id
    """,
)
def nearest_centroid(spark, d):
    e = t.table(spark, d, "embeddings")
    c = models.centroids(e, "label", "embedding")
    return models.zero_shot(e, "embedding", c, "label").select(
        "vec_id", "pred", F.round(F.array_max("scores"), 4).alias("score")
    )


def _suppress_sql(source: str = _CANDIDATES) -> str:
    """Greedy suppression, one candidate per step of a recursive query."""
    share = _OVERLAP.replace("b.", "q.").replace("a.", "c.")
    return f"""
    WITH RECURSIVE u AS (SELECT page_key, min(kind) AS kind, x0, y0, x1, y1, max(af) AS af
                         FROM {source} GROUP BY ALL),
      c AS (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY af DESC, x0, y0, x1, y1) AS rn FROM u),
      s AS (SELECT page_key, CAST(1 AS BIGINT) AS k,
                   [struct_pack(kind := kind, x0 := x0, y0 := y0, x1 := x1, y1 := y1, af := af)] AS kept
            FROM c WHERE rn = 1
            UNION ALL
            SELECT s.page_key, s.k + 1,
                   CASE WHEN len(list_filter(s.kept, lambda q: {share} >= 0.6)) = 0
                        THEN list_append(s.kept, struct_pack(kind := c.kind, x0 := c.x0, y0 := c.y0, x1 := c.x1, y1 := c.y1, af := c.af))
                        ELSE s.kept END
            FROM s JOIN c ON c.page_key = s.page_key AND c.rn = s.k + 1),
      f AS (SELECT page_key, unnest(arg_max(kept, k)) AS q FROM s GROUP BY page_key)
    SELECT page_key, q.kind AS kind, q.x0 AS x0, q.y0 AS y0, q.x1 AS x1, q.y1 AS y1, round(q.af, 6) AS area_frac
    FROM f"""


def _merge_sql(rounds: int = 8) -> str:
    """Merging to a fixpoint, unrolled: every box becomes the hull of the boxes
    its gap-expanded form meets. Pages of the test tables settle well before."""
    ctes = ["""m0 AS (SELECT DISTINCT page_key, x0, y0, x1, y1 FROM rects_v
                      WHERE kind = 'vector' AND x1 - x0 > 3 AND y1 - y0 > 3)"""]
    for i in range(rounds):
        ctes.append(f"""
    m{i + 1} AS (SELECT DISTINCT a.page_key, min(b.x0) AS x0, min(b.y0) AS y0, max(b.x1) AS x1, max(b.y1) AS y1
                 FROM m{i} a JOIN m{i} b ON a.page_key = b.page_key AND a.x0 - 14 < b.x1 AND a.x1 + 14 > b.x0
                  AND a.y0 - 14 < b.y1 AND a.y1 + 14 > b.y0
                 GROUP BY a.page_key, a.x0, a.y0, a.x1, a.y1)""")
    sides = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("x0", "y0", "x1", "y1"))
    return f"WITH {', '.join(ctes)} SELECT page_key, {sides} FROM m{rounds}"


@query("wn4_suppressed_candidates", _suppress_sql())
def suppressed_candidates(spark, d):
    return geometry.suppress(candidates(spark, d), "page_key").withColumn(
        "area_frac", F.round("area_frac", 6)
    )


@query("wn5_merged_rects", _merge_sql())
def merged_rects(spark, d):
    r = t.rects(spark, d)
    wide = (F.col("x1") - F.col("x0") > 3) & (F.col("y1") - F.col("y0") > 3)
    return geometry.merge_rects(r.filter((F.col("kind") == "vector") & wide), "page_key")


def _figures_sql() -> str:
    gate = _CANDIDATES.replace("rects_v", "raw")
    return f"""
    WITH RECURSIVE mm AS ({_merge_sql()}),
      raw AS (SELECT page_key, kind, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1,
                     CAST(y1 AS DOUBLE) AS y1 FROM rects_v WHERE kind = 'image'
              UNION ALL SELECT page_key, 'vector', x0, y0, x1, y1 FROM mm),
      cand AS (SELECT * FROM {gate}),
      apart AS (SELECT * FROM cand a WHERE kind = 'image' OR NOT EXISTS (
                SELECT 1 FROM cand b WHERE b.page_key = a.page_key AND b.kind = 'image' AND {_OVERLAP} > 0.6)),
      fig AS ({_suppress_sql("apart")}),
      cap AS ({_caption_sql("fig")})
    SELECT fig.*, cap.caption FROM fig JOIN cap USING (page_key, x0, y0, x1, y1)
    """


@query("e2_page_figures", _figures_sql())
def page_figures(spark, d):
    found = geometry.extract_figures(
        t.rects(spark, d), t.blocks(spark, d), "page_key", F.lit(t.PAGE_W), F.lit(t.PAGE_H)
    )
    return found.withColumn("area_frac", F.round("area_frac", 6))


@query(
    "flt8_pages_with_figures_and_captions",
    """
    SELECT page_key FROM blocks_v WHERE regexp_matches(txt, '(?i)^\\s*fig(?:ure)?\\.?\\s*\\d+')
    INTERSECT SELECT page_key FROM rects_v WHERE kind = 'image'
    """,
)
def pages_with_figures_and_captions(spark, d):
    named = t.blocks(spark, d).filter(is_caption(F.col("txt"))).select("page_key")
    return named.intersect(t.rects(spark, d).filter(F.col("kind") == "image").select("page_key"))

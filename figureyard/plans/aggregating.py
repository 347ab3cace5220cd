"""Report and counter queries."""

from pyspark.sql import functions as F

from figureyard.functions.columns import ratio
from figureyard.operators import reports
from figureyard.operators.gates import PHOTO_WORDS, PLOT_WORDS
from figureyard.operators.ranking import exact_percentiles
from figureyard.plans.catalog import query
from figureyard.plans.registration import page_verdicts
from figureyard.sources import tables as t

PAPER_STATUS = ("downloaded", "failed", "pending")


@query(
    "ag1_papers_by_status",
    "SELECT status, count(*) AS n FROM papers_v GROUP BY status",
)
def papers_by_status(spark, d):
    return t.papers(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ag1_fields_by_status",
    """
    SELECT field, count(*) AS total, count(*) FILTER (status = 'downloaded') AS downloaded,
           count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending
    FROM papers_v GROUP BY field
    """,
)
def fields_by_status(spark, d):
    return reports.status_counts(t.papers(spark, d), ["field"], PAPER_STATUS)


def counters(spark, d):
    pages = page_verdicts(spark, d).withColumn("status", F.lit("done"))
    images = t.images(spark, d).withColumn("cost", F.lit(0.5))
    batches = t.decisions(spark, d)
    return reports.pipeline_counters(t.papers(spark, d), pages, batches, images)


_COUNTERS = """
    SELECT (SELECT count(*) FROM papers_v) AS papers_total,
           (SELECT count(*) FROM papers_v WHERE status = 'pending') AS papers_pending,
           (SELECT count(*) FROM papers_v WHERE status = 'downloaded') AS papers_downloaded,
           (SELECT count(*) FROM verdicts_v) AS pages_total, CAST(0 AS BIGINT) AS pages_pending,
           (SELECT count(*) FROM verdicts_v WHERE has_diagram) AS pages_diagram,
           (SELECT count(*) FROM decisions_v WHERE status IN ('building', 'pending')) AS batches_pending,
           (SELECT count(*) FROM images_v) AS images_total,
           (SELECT count(*) FROM images_v WHERE status = 'pending') AS images_pending,
           (SELECT count(*) FROM images_v WHERE status = 'labeled') AS labeled,
           (SELECT count(*) FROM images_v WHERE status = 'rejected') AS rejected,
           (SELECT sum(cost) FROM verdicts_v) + (SELECT count(*) * 0.5::DOUBLE FROM images_v) AS cost
"""


@query("ag2_pipeline_counters", _COUNTERS)
def pipeline_counters(spark, d):
    return counters(spark, d)


@query(
    "ag3_fields_with_pending",
    """
    SELECT field, source, count(*) FILTER (status = 'downloaded') AS done FROM papers_v
    GROUP BY field, source HAVING count(*) FILTER (status = 'pending') > 0
    """,
)
def fields_with_pending(spark, d):
    return (
        t.papers(spark, d).groupBy("field", "source")
        .agg(
            F.count_if(F.col("status") == "downloaded").alias("done"),
            F.count_if(F.col("status") == "pending").alias("waiting"),
        )
        .filter(F.col("waiting") > 0).drop("waiting")
    )


@query(
    "ag4_cost_rollup",
    """
    SELECT field, round(sum(cost), 4) AS page_cost, n_labeled,
           round(coalesce(sum(cost) / nullif(n_labeled, 0), 0), 6) AS cost_per_accepted
    FROM verdicts_v JOIN (SELECT field, count(*) FILTER (status = 'labeled') AS n_labeled
                          FROM images_v GROUP BY field) USING (field)
    GROUP BY field, n_labeled
    """,
)
def cost_rollup(spark, d):
    cost = page_verdicts(spark, d).groupBy("field").agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("c")
    )
    labeled = t.images(spark, d).groupBy("field").agg(
        F.count_if(F.col("status") == "labeled").alias("n_labeled")
    )
    return cost.join(labeled, "field").select(
        "field", F.round("c", 4).alias("page_cost"), "n_labeled",
        F.round(ratio(F.col("c"), F.col("n_labeled")), 6).alias("cost_per_accepted"),
    )


@query(
    "ag5_hit_rate",
    """
    SELECT field, count(*) AS detected, count(*) FILTER (has_diagram) AS diagram,
           round(100.0::DOUBLE * count(*) FILTER (has_diagram) / count(*), 4) AS hit_rate
    FROM verdicts_v GROUP BY field
    """,
)
def hit_rate(spark, d):
    rows = page_verdicts(spark, d).groupBy("field").agg(
        F.count(F.lit(1)).alias("detected"), F.count_if("has_diagram").alias("diagram")
    )
    rate = ratio(F.col("diagram") * 100, F.col("detected"))
    return rows.withColumn("hit_rate", F.round(rate, 4))


@query(
    "ag6_top_reject_reasons",
    """
    SELECT reject_reason, count(*) AS n FROM images_v WHERE reject_reason <> ''
    GROUP BY reject_reason ORDER BY n DESC, reject_reason LIMIT 5
    """,
)
def top_reject_reasons(spark, d):
    i = t.images(spark, d).filter(F.col("reject_reason") != "")
    return reports.top_values(i, F.col("reject_reason"), "reject_reason", 5)


@query(
    "ag6_top_unmapped_prefixes",
    """
    SELECT prefix, count(*) AS n FROM (
      SELECT substr(text, 1, 40) AS prefix FROM documents
      WHERE NOT regexp_matches(lower(text), 'plot|heatmap|chart|graph of|phase map|spectrogram|histogram|photo|micrograph'))
    GROUP BY prefix ORDER BY n DESC, prefix LIMIT 8
    """,
)
def top_unmapped_prefixes(spark, d):
    texts = t.table(spark, d, "documents").select("text")
    known = F.lower("text").rlike("|".join(PLOT_WORDS + PHOTO_WORDS))
    return reports.top_values(texts.filter(~known), reports.reason_prefix(F.col("text")), "prefix", 8)


@query(
    "ag13_latency_statistics",
    """
    SELECT model, device, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95,
           round(avg(ms), 4) AS mean_ms, round(max(ms), 6) AS peak, count(*) AS n
    FROM timings_v GROUP BY model, device
    """,
)
def latency_statistics(spark, d):
    rows = t.timings(spark, d)
    points = exact_percentiles(rows, ["model", "device"], "ms", {"p50": 0.5, "p95": 0.95})
    plain = rows.groupBy("model", "device").agg(
        F.round(F.avg("ms"), 4).alias("mean_ms"), F.round(F.max("ms"), 6).alias("peak"),
        F.count(F.lit(1)).alias("n"),
    )
    return points.join(plain, ["model", "device"]).withColumns(
        {"p50": F.round("p50", 6), "p95": F.round("p95", 6)}
    )


@query(
    "ag14_value_statistics",
    """
    SELECT page_key, min(v) FILTER (c = mc) AS mode, round(any_value(sd), 6) AS std FROM (
      SELECT *, max(c) OVER (PARTITION BY page_key) AS mc FROM (
        SELECT l_suppkey AS page_key, CAST(l_quantity AS INT) AS v, count(*) AS c FROM lineitem GROUP BY ALL))
    JOIN (SELECT l_suppkey AS page_key, stddev_pop(CAST(l_quantity AS INT)) AS sd FROM lineitem GROUP BY 1) USING (page_key)
    GROUP BY page_key
    """,
)
def value_statistics(spark, d):
    # equal values are counted for the mode; deviations are merged around their means
    v = t.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("page_key"), F.col("l_quantity").cast("int").alias("v")
    )
    counts = v.groupBy("page_key", "v").agg(F.count(F.lit(1)).alias("c"))
    modes = counts.groupBy("page_key").agg(F.max_by("v", F.struct("c", -F.col("v"))).alias("mode"))
    spread = v.groupBy("page_key").agg(F.round(F.stddev_pop("v"), 6).alias("std"))
    return modes.join(spread, "page_key")


@query(
    "ag16_accepted_facets",
    "SELECT field, source, count(*) AS n FROM images_v JOIN (SELECT doc_id, source FROM documents) ON doc_id = image_id WHERE status = 'labeled' GROUP BY field, source",
)
def accepted_facets(spark, d):
    labeled = t.images(spark, d).filter(F.col("status") == "labeled").select("image_id", "field")
    origin = t.table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), "source")
    return (
        labeled.join(origin, "image_id").groupBy("field", "source")
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "field", "source")
    )


@query(
    "ag17_funnel",
    """
    WITH s AS (SELECT 0 AS step, 'papers' AS stage, count(*) AS n FROM papers_v
               UNION ALL SELECT 1, 'pages', count(*) FROM verdicts_v
               UNION ALL SELECT 2, 'diagram_pages', count(*) FROM verdicts_v WHERE has_diagram
               UNION ALL SELECT 3, 'crops', count(*) FROM images_v
               UNION ALL SELECT 4, 'accepted', count(*) FROM images_v WHERE status = 'labeled')
    SELECT step, stage, n, round_even(coalesce(n / lag(n) OVER (ORDER BY step)::DOUBLE, 0), 4) AS share FROM s
    """,
)
def funnel(spark, d):
    pages, images = page_verdicts(spark, d), t.images(spark, d)
    return reports.funnel(
        [
            ("papers", t.papers(spark, d)),
            ("pages", pages),
            ("diagram_pages", pages.filter("has_diagram")),
            ("crops", images),
            ("accepted", images.filter(F.col("status") == "labeled")),
        ]
    )


@query(
    "ag19_positive_pages",
    """
    SELECT arxiv_id, page_no, bool_or(status = 'labeled') AS positive FROM images_v GROUP BY arxiv_id, page_no
    """,
)
def positive_pages(spark, d):
    return t.images(spark, d).groupBy("arxiv_id", "page_no").agg(
        F.max(F.col("status") == "labeled").alias("positive")
    )


@query(
    "ag20_demand",
    f"""
    WITH c AS ({_COUNTERS}),
         y AS (SELECT *, CASE WHEN papers_downloaded >= 30 AND labeled >= 30
                              THEN greatest(0.5, labeled / papers_downloaded::DOUBLE) ELSE 3.0 END AS ey,
                      30000 - labeled AS remaining FROM c)
    SELECT remaining, round_even(ey, 4) AS est_yield, CAST(trunc(remaining / ey * 1.3::DOUBLE) AS INT) AS needed,
           least(CAST(trunc(remaining / ey * 1.3::DOUBLE) AS INT), 1500) AS buffer_target FROM y
    """,
)
def demand(spark, d):
    return reports.demand(counters(spark, d), 30000)


@query(
    "ag21_throughput",
    """
    SELECT done, seconds, round_even(done / seconds::DOUBLE * 3600, 4) AS per_hour,
           round_even(greatest(1000000 - done, 0) / (done / seconds::DOUBLE), 2) AS seconds_left
    FROM (SELECT count(*) FILTER (status = 'labeled') AS done,
                 CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM decisions_v)
    """,
)
def throughput(spark, d):
    return reports.throughput(t.decisions(spark, d), F.col("status") == "labeled", 1_000_000)


@query(
    "ag22_label_provenance",
    """
    SELECT CASE WHEN pred_a = pred_b THEN 'rater_consensus' ELSE 'adjudicated' END AS source,
           CASE WHEN p_diagram BETWEEN 0.4 AND 0.6 THEN 1 ELSE 0 END AS uncertain, count(*) AS n
    FROM preds_v GROUP BY 1, 2
    """,
)
def label_provenance(spark, d):
    p = t.predictions(spark, d)
    source = F.when(F.col("pred_a") == F.col("pred_b"), "rater_consensus").otherwise("adjudicated")
    unsure = F.col("p_diagram").between(0.4, 0.6).cast("int")
    return p.groupBy(source.alias("source"), unsure.alias("uncertain")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "ag23_judge_agreement",
    """
    SELECT count(*) AS n, round_even(avg(CASE WHEN screen_pos = confirm_pos THEN 1.0::DOUBLE ELSE 0 END), 4) AS agree,
           round_even(avg(confirm_cost) / avg(screen_cost), 4) AS cost_ratio
    FROM pages_v WHERE has_graphics
    """,
)
def judge_agreement(spark, d):
    g = t.pages(spark, d).filter("has_graphics")
    keys = ["arxiv_id", "page_no"]
    a = g.select(*keys, F.col("screen_pos").alias("verdict_a"), F.col("screen_cost").alias("cost_a"))
    b = g.select(*keys, F.col("confirm_pos").alias("verdict_b"), F.col("confirm_cost").alias("cost_b"))
    return reports.agreement(a, b, keys)

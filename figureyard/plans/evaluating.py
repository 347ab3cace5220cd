"""Prediction quality: metrics, intervals, tests, sweeps, leaderboards."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from figureyard.functions.columns import ratio
from figureyard.operators import evaluation as ev
from figureyard.plans.catalog import query
from figureyard.sources import tables as t

_CELLS = """
    SELECT {by} count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp,
           count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM ({src}) {group}
"""
_METRICS = """
    {by} round_even((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 4) AS acc,
    round_even(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 4) AS precision,
    round_even(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 4) AS recall,
    round_even(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 4) AS f1, tp + fp + fn + tn AS n
"""
_BIN = "SELECT field, CASE WHEN y4 = 0 THEN 1 ELSE 0 END AS y, CASE WHEN {g} = 0 THEN 1 ELSE 0 END AS p FROM preds_v"


def _cells_sql(guess="pred_a", by="", src=None):
    return _CELLS.format(by=f"{by}," if by else "", src=src or _BIN.format(g=guess),
                         group=f"GROUP BY {by}" if by else "")


def _metrics_sql(guess="pred_a", by=""):
    return f"SELECT {_METRICS.format(by=f'{by},' if by else '')} FROM ({_cells_sql(guess, by)})"


def _truth():
    return F.col("y4") == 0


@query("ag8_binary_metrics", _metrics_sql())
def binary_metrics(spark, d):
    return ev.binary_metrics(t.predictions(spark, d), _truth(), F.col("pred_a") == 0)


@query("ag8_binary_metrics_per_field", _metrics_sql("pred_b", "field"))
def binary_metrics_per_field(spark, d):
    return ev.binary_metrics(t.predictions(spark, d), _truth(), F.col("pred_b") == 0, ["field"])


@query(
    "ag9_class_accuracy",
    "SELECT round_even(avg(CASE WHEN y4 = pred_a THEN 1.0::DOUBLE ELSE 0 END), 4) AS acc4, count(*) AS n FROM preds_v",
)
def class_accuracy(spark, d):
    return ev.class_accuracy(t.predictions(spark, d), "y4", "pred_a")


@query(
    "ag10_confusion_matrix",
    "SELECT k AS truth, "
    + ", ".join(f"count(*) FILTER (pred_a = {i}) AS pred_{i}" for i in range(4))
    + " FROM range(0, 4) r(k) LEFT JOIN preds_v ON y4 = k GROUP BY k",
)
def confusion_matrix(spark, d):
    return ev.confusion(t.predictions(spark, d), "y4", "pred_a")


@query(
    "ag11_slice_accuracy",
    """
    SELECT coalesce(field, '?') AS field, round_even(avg(CASE WHEN (y4 = 0) = (pred_a = 0) THEN 1.0::DOUBLE ELSE 0 END), 4) AS acc,
           count(*) AS n
    FROM (SELECT *, image_id AS i FROM preds_v) GROUP BY 1 HAVING count(*) >= 10
    """,
)
def slice_accuracy(spark, d):
    return ev.slices(t.predictions(spark, d), "field", _truth(), F.col("pred_a") == 0)


@query(
    "ag12_teacher_vs_gold",
    f"SELECT {_METRICS.format(by='')} FROM ({_cells_sql(src='SELECT quality AS y, 1 - toxic AS p FROM labels')})",
)
def teacher_vs_gold(spark, d):
    labels = t.table(spark, d, "labels")
    return ev.binary_metrics(labels, F.col("quality") == 1, F.col("toxic") == 0)


def _interval(df, point):
    """What holds for any right interval: it covers the point value, and for a
    share of n rows it is as wide as the normal one, up to a tenth."""
    return df.select(
        F.round("point", 4).alias("point"),
        ((F.col("lo") <= F.col("point")) & (F.col("point") <= F.col("hi"))).alias("covered"),
        (F.abs((F.col("hi") - F.col("lo")) / point - 1) < 0.1).alias("near_normal"),
    )


@query(
    "ml7_bootstrap_accuracy",
    f"""SELECT round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 4) AS point, true AS covered, true AS near_normal
        FROM ({_cells_sql()})""",
)
def bootstrap_accuracy(spark, d):
    cells = ev.cells(t.predictions(spark, d), _truth(), F.col("pred_a") == 0)
    p, n = F.col("point"), cells.select(F.expr("tp + fp + fn + tn")).scalar()
    return _interval(ev.bootstrap(cells, ev.METRICS["acc"]), 2 * 1.959964 * F.sqrt(p * (1 - p) / n))


_BALANCED = "(tp / greatest(tp + fn, 1) + tn / greatest(tn + fp, 1)) / 2"


@query(
    "ml7_bootstrap_custom_metric",
    f"SELECT round({_BALANCED}, 4) AS point, true AS covered, true AS near_normal FROM ({_cells_sql('pred_b')})",
)
def bootstrap_custom_metric(spark, d):
    cells = ev.cells(t.predictions(spark, d), _truth(), F.col("pred_b") == 0)
    # both rates are shares of their own rows
    tp, fn = (cells.select(c).scalar() for c in ("tp", "fn"))
    tn, fp = (cells.select(c).scalar() for c in ("tn", "fp"))
    spread = F.sqrt(tp * fn / F.pow(tp + fn, 3) + tn * fp / F.pow(tn + fp, 3)) / 2
    return _interval(ev.bootstrap(cells, _BALANCED), 2 * 1.959964 * spread)


@query(
    "ml6_evaluation",
    f"""
    WITH a AS ({_metrics_sql()})
    SELECT 'model_a' AS name, a.*, (SELECT round_even(avg((y4 = pred_a)::INT), 4) FROM preds_v) AS acc4,
           true AS f1_covered, true AS acc_covered FROM a
    """,
)
def evaluation(spark, d):
    """Metrics, class accuracy and intervals of one prediction set."""
    p = t.predictions(spark, d)
    guess = F.col("pred_a") == 0
    cells = ev.cells(p, _truth(), guess)
    f1 = ev.bootstrap(cells, "2 * tp / greatest(2 * tp + fp + fn, 1)")
    acc = ev.bootstrap(cells, ev.METRICS["acc"])
    covered = "lo <= point AND point <= hi AND hi - lo < 0.2"
    return ev.binary_metrics(p, _truth(), guess).select(
        F.lit("model_a").alias("name"), "*",
        ev.class_accuracy(p, "y4", "pred_a").select("acc4").scalar().alias("acc4"),
        f1.select(F.expr(covered)).scalar().alias("f1_covered"),
        acc.select(F.expr(covered)).scalar().alias("acc_covered"),
    )


def two_sides(spark, d, preds):
    """Prediction sets (name, image_id, pred4) beside silver and gold classes. Gold
    is a rater's yes or no: a no keeps the silver class unless that is a yes."""
    p = t.predictions(spark, d).select("image_id", F.col("y4").cast("int").alias("silver"), "field")
    labels = t.table(spark, d, "labels").select(F.col("doc_id").alias("image_id"), "quality")
    gold = F.when(F.col("quality") == 1, 0).otherwise(F.greatest("silver", F.lit(1)))
    known = p.join(labels, "image_id", "left").withColumn("gold", F.when(F.col("quality").isNotNull(), gold))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("y4")) for s in ("silver", "gold")])
    return preds.join(known, "image_id").select("name", "field", "pred4", F.inline(sides)).filter("y4 IS NOT NULL")


def _both_models(spark, d):
    p = t.predictions(spark, d)
    sets = [F.struct(F.lit(n).alias("name"), F.col(c).cast("int").alias("pred4"))
            for n, c in (("model_a", "pred_a"), ("model_b", "pred_b"))]
    return two_sides(spark, d, p.select("image_id", F.inline(F.array(*sets))))


_SIDES = """
    p AS (SELECT v.*, quality FROM preds_v v LEFT JOIN labels ON doc_id = image_id),
    s AS (SELECT image_id, field, pred_a, pred_b, 'silver' AS side, y4 FROM p UNION ALL
          SELECT image_id, field, pred_a, pred_b, 'gold', CASE WHEN quality = 1 THEN 0 ELSE greatest(y4, 1) END
          FROM p WHERE quality IS NOT NULL),
    j AS (SELECT 'model_a' AS name, side, field, y4, pred_a AS p4 FROM s UNION ALL
          SELECT 'model_b', side, field, y4, pred_b FROM s)
"""
_COUNTS = " || ',' || ".join(f"count(*) FILTER (y4 = {i} AND p4 = {j})" for i in range(4) for j in range(4))


@query(
    "ml6_two_sided_report",
    f"""
    WITH {_SIDES},
      m AS (SELECT {_METRICS.format(by='name, side,')} FROM ({_CELLS.format(
          by='name, side,', group='GROUP BY name, side',
          src='SELECT name, side, (y4 = 0)::INT AS y, (p4 = 0)::INT AS p FROM j')})),
      c AS (SELECT name, side, round_even(avg(CASE WHEN y4 = p4 THEN 1.0::DOUBLE ELSE 0 END), 4) AS acc4,
                   {_COUNTS} AS confusion FROM j GROUP BY name, side),
      f AS (SELECT name, side, field || ':' || count(*) FILTER ((y4 = 0) = (p4 = 0)) || '/' || count(*) AS line
            FROM j GROUP BY name, side, field HAVING count(*) >= 10),
      l AS (SELECT name, side, string_agg(line, ' ' ORDER BY line) AS slices FROM f GROUP BY name, side)
    SELECT m.*, acc4, confusion, coalesce(slices, '') AS slices
    FROM m JOIN c USING (name, side) LEFT JOIN l USING (name, side)
    """,
)
def two_sided_report(spark, d):
    """Each prediction set against silver and gold: metrics, confusion, slices."""
    lines = F.transform("slices", lambda s: F.concat_ws("", s["field"], F.lit(":"), s["hits"], F.lit("/"), s["n"]))
    return ev.evaluation_report(_both_models(spark, d)).select(
        "name", "side", "acc", "precision", "recall", "f1", "n", "acc4",
        F.concat_ws(",", F.transform(F.flatten("confusion"), lambda c: c.cast("string"))).alias("confusion"),
        F.concat_ws(" ", F.array_sort(lines)).alias("slices"),
    )


@query("ml6_two_sided_intervals")
def two_sided_intervals(spark, d):
    """The bootstrap intervals themselves, which depend on the draws."""
    ends = [f"{m}_{e}" for m in ("acc", "f1") for e in ("lo", "hi")]
    found = ev.evaluation_report(_both_models(spark, d))
    return found.select("name", "side", "n", "acc", "f1", *[F.round(c, 4).alias(c) for c in ends])


@query(
    "ml8_mcnemar",
    """
    SELECT n10, n01, round((abs(n10 - n01) - 1) * (abs(n10 - n01) - 1) / greatest(n10 + n01, 1)::DOUBLE, 6) AS stat FROM (
      SELECT count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (NOT a AND b) AS n01 FROM (
        SELECT (y4 = 0) = (pred_a = 0) AS a, (y4 = 0) = (pred_b = 0) AS b FROM preds_v))
    """,
)
def mcnemar(spark, d):
    p = t.predictions(spark, d)
    out = ev.mcnemar(p, _truth(), F.col("pred_a") == 0, F.col("pred_b") == 0)
    return out.select("n10", "n01", F.round("stat", 6).alias("stat"))


@query(
    "ml8_mcnemar_p_value",
    """
    SELECT n10, n01, round(1 - 2 / sqrt(pi()) * sum(pow(-1, n) * pow(x, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))), 6) AS p
    FROM (SELECT n10, n01, sqrt((abs(n10 - n01) - 1) * (abs(n10 - n01) - 1) / greatest(n10 + n01, 1)::DOUBLE / 2) AS x FROM (
            SELECT count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (NOT a AND b) AS n01 FROM (
              SELECT (y4 = 0) = (pred_a = 0) AS a, (y4 = 0) = (pred_b = 0) AS b FROM preds_v))),
         range(0, 100) r(n)
    GROUP BY n10, n01
    """,
)
def mcnemar_p_value(spark, d):
    p = t.predictions(spark, d)
    out = ev.mcnemar(p, _truth(), F.col("pred_a") == 0, F.col("pred_b") == 0)
    return out.select("n10", "n01", F.round("p", 6).alias("p"))


@query(
    "ml9_kappa",
    """
    WITH pr AS (SELECT pred_a AS a, pred_b AS b, count(*) AS n FROM preds_v GROUP BY ALL),
         tt AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) AS same FROM pr),
         ch AS (SELECT sum(ra * rb) AS e FROM (SELECT a AS c, sum(n) AS ra FROM pr GROUP BY a)
                JOIN (SELECT b AS c, sum(n) AS rb FROM pr GROUP BY b) USING (c))
    SELECT CAST(n AS BIGINT) AS n, CAST(n - same AS BIGINT) AS disagreements,
           round_even((same / n::DOUBLE - e / (n::DOUBLE * n)) / (1 - e / (n::DOUBLE * n)), 4) AS kappa FROM tt, ch
    """,
)
def kappa(spark, d):
    return ev.kappa(t.predictions(spark, d), "pred_a", "pred_b")


_BANDS = """
    WITH g AS (SELECT i, i / 100::DOUBLE AS v FROM range(5, 100, 5) r(i)),
         b AS (SELECT lo.i AS li, hi.i AS hi_i, lo.v AS lo, hi.v AS hi FROM g lo JOIN g hi ON hi.i >= lo.i),
         s AS (SELECT li, hi_i, lo, hi, count(*) AS n_all, count(*) FILTER (p_diagram >= hi OR p_diagram <= lo) AS decided,
                      count(*) FILTER ((p_diagram >= hi AND y4 = 0) OR (p_diagram <= lo AND y4 <> 0)) AS correct,
                      count(*) FILTER (p_diagram >= hi) AS acc_n, count(*) FILTER (p_diagram >= hi AND y4 = 0) AS acc_pos
               FROM preds_v, b GROUP BY ALL),
         tb AS (SELECT li, hi_i, lo, hi, round_even(decided / n_all::DOUBLE, 4) AS coverage,
                       round_even(correct / decided::DOUBLE, 4) AS decided_acc,
                       round_even(coalesce(acc_pos / nullif(acc_n, 0)::DOUBLE, 0), 4) AS accept_precision
                FROM s WHERE decided >= n_all * 0.3::DOUBLE)
"""


@query(
    "ml10_abstention_bands",
    _BANDS + """
    SELECT lo, hi, coverage, decided_acc, accept_precision FROM tb ORDER BY coverage DESC, li, hi_i LIMIT 200
    """,
)
def abstention_bands(spark, d):
    table = ev.band_sweep(t.predictions(spark, d), _truth(), "p_diagram", 0.95)
    return ev.top_bands(table).select("lo", "hi", "coverage", "decided_acc", "accept_precision")


@query(
    "ml10_best_band",
    _BANDS + """
    SELECT lo, hi, coverage, decided_acc, accept_precision, accept_precision >= 0.95 AS ok FROM tb
    ORDER BY ok DESC, CASE WHEN accept_precision >= 0.95 THEN coverage ELSE accept_precision END DESC, li, hi_i LIMIT 1
    """,
)
def best_band(spark, d):
    return ev.best_band(ev.band_sweep(t.predictions(spark, d), _truth(), "p_diagram", 0.95))


_SWEEP = f"""
    WITH g AS (SELECT row_number() OVER (ORDER BY c, a) - 1 AS ord, c, a FROM
                 (VALUES (0.2::DOUBLE), (0.3), (0.4), (0.5), (0.6)) x(c), (VALUES (0.01::DOUBLE), (0.03), (0.05)) y(a)),
         pg AS (SELECT ord, c, a, page_key, max(has_diagram) AS y,
                       max(CASE WHEN cls = 'figure' AND conf >= c AND (x1 - x0) * (y1 - y0) >= a * w * h THEN 1 ELSE 0 END) AS p
                FROM boxes_v, g GROUP BY ord, c, a, page_key),
         ct AS ({_CELLS.format(by='ord, c, a,', src='SELECT * FROM pg', group='GROUP BY ord, c, a')}),
         sw AS (SELECT {_METRICS.format(by='CAST(ord AS INT) AS ord, c AS conf_t, a AS area_t,')} FROM ct)
"""


@query("ml11_detector_sweep", _SWEEP + "SELECT * FROM sw")
def detector_sweep(spark, d):
    return ev.detector_sweep(t.boxes(spark, d), "page_key")


@query("wn8_best_threshold", _SWEEP + "SELECT * FROM sw ORDER BY f1 DESC, ord LIMIT 1")
def best_threshold(spark, d):
    return ev.first_best(ev.detector_sweep(t.boxes(spark, d), "page_key"), "f1", "ord")


@query(
    "ml12_detector_teacher_gold",
    f"""
    WITH gold AS (SELECT o_orderkey AS page_key, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS y FROM orders WHERE o_orderstatus = 'F'),
         pg AS (SELECT page_key, max(has_diagram) AS silver,
                       max(CASE WHEN cls = 'figure' AND conf >= 0.3 AND (x1 - x0) * (y1 - y0) >= 0.03::DOUBLE * w * h THEN 1 ELSE 0 END) AS gate
                FROM boxes_v GROUP BY page_key),
         j AS (SELECT y, silver, gate FROM pg JOIN gold USING (page_key)),
         u AS (SELECT 'detector' AS judge, y, gate AS p FROM j UNION ALL SELECT 'teacher', y, silver FROM j)
    SELECT {_METRICS.format(by='judge,')}, true AS acc_covered, true AS f1_covered
    FROM ({_CELLS.format(by='judge,', src='SELECT * FROM u', group='GROUP BY judge')})
    """,
)
def detector_teacher_gold(spark, d):
    orders = t.table(spark, d, "orders").filter(F.col("o_orderstatus") == "F")
    gold = orders.select(
        F.col("o_orderkey").alias("page_key"), (F.col("o_orderkey") % 2 == 0).alias("gold")
    )
    big = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= F.lit(0.03) * F.col("w") * F.col("h")
    hit = (F.col("cls") == "figure") & (F.col("conf") >= 0.3) & big
    pages = t.boxes(spark, d).groupBy("page_key").agg(
        F.max(hit).alias("gate"), F.max(F.col("has_diagram") == 1).alias("silver")
    )
    judged = pages.join(gold, "page_key").select(
        "gold",
        F.inline(
            F.array(
                F.struct(F.lit("detector").alias("judge"), F.col("gate").alias("guess")),
                F.struct(F.lit("teacher").alias("judge"), F.col("silver").alias("guess")),
            )
        ),
    )
    counts = ev.cells(judged, F.col("gold"), F.col("guess"), ["judge"])
    wanted = {m: ev.METRICS[m] for m in ("acc", "f1")}
    ends = ev.grouped_intervals(counts, ["judge"], wanted)
    covered = [
        ((F.col(f"{m}_lo") <= F.col(m)) & (F.col(m) <= F.col(f"{m}_hi"))).alias(f"{m}_covered")
        for m in wanted
    ]
    found = ev.metrics(counts, ["judge"])
    return found.join(ends, "judge").select(*found.columns, *covered)


@query(
    "ml14_leaderboard",
    """
    WITH m AS (SELECT name, round_even(avg(CASE WHEN p = y4 THEN 1.0::DOUBLE ELSE 0 END), 4) AS silver,
                      round_even(avg(CASE WHEN (p = 0) = (quality = 1) THEN 1.0::DOUBLE ELSE 0 END), 4) AS gold, count(quality) AS n_gold
               FROM (SELECT 'model_a' AS name, image_id, y4, pred_a AS p FROM preds_v
                     UNION ALL SELECT 'model_b', image_id, y4, pred_b FROM preds_v
                     UNION ALL SELECT 'teacher', image_id, y4, y4 FROM preds_v)
               JOIN labels ON doc_id = image_id GROUP BY name)
    SELECT name, silver, gold, n_gold, CAST(rank() OVER (ORDER BY gold DESC) AS INT) AS gold_rank,
           CAST(rank() OVER (ORDER BY silver DESC) AS INT) AS silver_rank,
           rank() OVER (ORDER BY gold DESC) <> rank() OVER (ORDER BY silver DESC) AS flipped,
           CASE WHEN name = 'teacher' THEN 'judge' ELSE 'probe' END AS rung,
           row_number() OVER (PARTITION BY name = 'teacher' ORDER BY gold DESC, name) = 1 AS best_of_rung FROM m
    """,
)
def leaderboard(spark, d):
    p = t.predictions(spark, d)
    both = p.select(
        "image_id", "y4",
        F.inline(
            F.array(
                F.struct(F.lit("model_a").alias("name"), F.col("pred_a").alias("p")),
                F.struct(F.lit("model_b").alias("name"), F.col("pred_b").alias("p")),
                F.struct(F.lit("teacher").alias("name"), F.col("y4").alias("p")),
            )
        ),
    )
    labels = t.table(spark, d, "labels").select(F.col("doc_id").alias("image_id"), "quality")
    rows = both.join(labels, "image_id").groupBy("name").agg(
        F.bround(F.avg((F.col("p") == F.col("y4")).cast("double")), 4).alias("silver"),
        F.bround(F.avg(((F.col("p") == 0) == (F.col("quality") == 1)).cast("double")), 4).alias("gold"),
        F.count("quality").alias("n_gold"),
    )
    # one row per model: the ranking windows see a handful of rows
    return rows.select(
        "*",
        F.rank().over(Window.orderBy(F.desc("gold"))).alias("gold_rank"),
        F.rank().over(Window.orderBy(F.desc("silver"))).alias("silver_rank"),
        F.when(F.col("name") == "teacher", "judge").otherwise("probe").alias("rung"),
    ).withColumns(
        {
            "flipped": F.col("gold_rank") != F.col("silver_rank"),
            "best_of_rung": F.row_number().over(Window.partitionBy("rung").orderBy(F.desc("gold"), "name")) == 1,
        }
    )


@query(
    "wn9_disagreements",
    "SELECT image_id, pred_a AS rater_a, pred_b AS rater_b FROM preds_v WHERE pred_a <> pred_b",
)
def disagreements(spark, d):
    p = t.predictions(spark, d)
    a = p.select("image_id", F.col("pred_a").alias("rater_a"))
    b = p.select("image_id", F.col("pred_b").alias("rater_b"))
    return a.join(b, "image_id").filter(F.col("rater_a") != F.col("rater_b"))


@query(
    "ag12_disagreement_rates",
    """
    SELECT field, round_even(avg(CASE WHEN pred_a <> y4 THEN 1.0::DOUBLE ELSE 0 END), 4) AS silver_wrong,
           count(*) FILTER (pred_a <> y4) AS n_wrong FROM preds_v GROUP BY field
    """,
)
def disagreement_rates(spark, d):
    wrong = F.col("pred_a") != F.col("y4")
    rows = t.predictions(spark, d).groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("n_wrong")
    )
    return rows.select(
        "field", F.bround(ratio(F.col("n_wrong"), F.col("n")), 4).alias("silver_wrong"), "n_wrong"
    )

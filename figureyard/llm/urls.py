"""URL filter: rules first, then a ratio of character language models.

Rules decide the hosts and paths that they name. All other URLs are judged by
two Markov models over characters, one of the accepted and one of the rejected
URLs among those the rules decide. The order varies with what was seen: the
estimate at three characters of context is smoothed by that at two, and so on
(a Dirichlet prior at each order). A URL's score is the log-likelihood
difference for each character; it is accepted above a threshold calibrated on
decided URLs that the models were not fitted on, where both kinds of error are
equal if scores are normal.

Characters fold to 31 symbols (letters, one for digits, four marks, one for the
rest) with one for both ends, so that a window of four is a number below 2**20:
the table of windows has at most that many rows whatever the input, which is why
it may be broadcast. Counts come from every decided URL.

A null URL, or one without ``://``, has an empty host and path and matches no
rule; an empty text scores 0 and is accepted. Without decided URLs of both kinds
all scores are 0 and everything is accepted. Repeated rows are judged alike,
extra columns ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figureyard.llm.common import LOWER, UPPER, Workspace, let, table

# Rules as (verdict, host, path); the longest that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./-"  # 1..30; 31 is any other, 0 both ends
ORDERS = 4  # characters in a window
PRIOR = 4.0  # weight of the shorter context
HELD_OUT = "012"  # first digits of md5(url) that calibrate


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.regexp_extract(url, r"^[\s\S]*?://([\s\S]*)$", 1)
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*(/[^?#]*)?", 1)
    return host, path


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict (null where no rule fits)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = rule.when(fits, h + p), verdict.when(fits, kind)
    return rows.withColumn("rule", rule).withColumn("verdict", verdict)


def windows(url: Column) -> Column:
    """The numbers of a URL's windows of four symbols, one for each symbol and
    one for the end; earlier positions than the first count as ends."""
    odd = "[^" + LOWER + "0-9./-]"
    folded = F.regexp_replace(F.translate(url, UPPER, LOWER), odd, "_")
    folded = F.translate(folded, "123456789", "0" * 9)
    place = "".join(SYMBOLS) + "_"
    codes = F.transform(
        F.split(folded, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(place), c))
    )
    padded = F.concat(F.array_repeat(F.lit(0), 3), F.filter(codes, lambda c: c > 0), F.array(F.lit(0)))
    return let(
        padded,
        lambda s: F.transform(
            F.sequence(F.lit(3), F.size(s) - 1),
            lambda i: F.get(s, i - 3) * 32768 + F.get(s, i - 2) * 1024
            + F.get(s, i - 1) * 32 + F.get(s, i),
        ),
    )


def ratios(work: Workspace, counts: DataFrame) -> DataFrame:
    """(code, ratio) of windows from (code, yes, no): the log ratio of both
    models' smoothed estimates. At most 2**20 rows in and out."""
    out = counts.withColumn("p_yes", F.lit(1 / 32)).withColumn("p_no", F.lit(1 / 32))
    for order in range(1, ORDERS + 1):
        # windows that end alike share the shorter context's count
        gram, context = F.col("code") % 32**order, F.floor(F.col("code") % 32**order / 32)
        grams = counts.groupBy(gram.alias("g")).agg(F.sum("yes").alias("gy"), F.sum("no").alias("gn"))
        contexts = counts.groupBy(context.alias("c")).agg(F.sum("yes").alias("cy"), F.sum("no").alias("cn"))
        out = (
            out.withColumn("g", gram).withColumn("c", context).join(grams, "g").join(contexts, "c")
            .withColumn("p_yes", (F.col("gy") + PRIOR * F.col("p_yes")) / (F.col("cy") + PRIOR))
            .withColumn("p_no", (F.col("gn") + PRIOR * F.col("p_no")) / (F.col("cn") + PRIOR))
            .drop("g", "c", "gy", "gn", "cy", "cn")
        )
    return work.save(out.select("code", (F.log("p_yes") - F.log("p_no")).alias("ratio")), "ratios")


def threshold(scored: DataFrame) -> float:
    """Where both errors are equal for normal scores of held-out decided URLs;
    never above 0, the score of no evidence."""
    r = scored.groupBy("verdict").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    found = {x["verdict"]: (x["m"], x["s"] + 1e-9) for x in r.collect()}
    if len(found) < 2:
        return -math.inf
    (my, sy), (mn, sn) = found["allow"], found["block"]
    return min(0.0, (my * sn + mn * sy) / (sy + sn))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and decided_by for every row."""
    work = Workspace(pages.sparkSession, "urls")
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = ruled(pages.select("page_id", "url"), rules)
    rows = rows.withColumn("held_out", F.substring(F.md5(url), 1, 1).isin(*HELD_OUT))
    coded = rows.withColumn("code", F.explode(windows(url)))
    fitted = F.col("verdict").isNotNull() & ~F.col("held_out")
    # every window of the table is listed, counted where rules decide
    counts = work.save(
        coded.groupBy("code").agg(
            F.count_if(fitted & (F.col("verdict") == "allow")).alias("yes"),
            F.count_if(fitted & (F.col("verdict") == "block")).alias("no"),
        ),
        "counts",
    )
    kinds = counts.agg(F.max("yes").alias("yes"), F.max("no").alias("no")).first()
    known = bool(kinds["yes"] and kinds["no"])
    model = ratios(work, counts)
    # at most 2**20 rows of an integer and a double
    by_window = F.broadcast(model)
    scored = (
        rows.withColumn("row", F.monotonically_increasing_id())
        .withColumn("code", F.explode(windows(url)))
        .join(by_window, "code")
        .groupBy("row")
        .agg(
            *[F.any_value(c).alias(c) for c in ("page_id", "host", "path", "rule", "verdict", "held_out")],
            (F.sum("ratio") / F.count("*") if known else F.lit(0.0)).alias("score"),
            F.any_value(F.length(url)).alias("_n"),
        )
        .drop("row")
        .withColumn("score", F.when(F.col("_n") == 0, 0.0).otherwise(F.round("score", 9)))
    )
    scored = work.save(scored, "scored")
    line = threshold(scored.where("held_out and verdict is not null")) if known else -math.inf
    by_model = F.when(F.col("score") >= F.lit(line), "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", by_model).alias("verdict"), "score",
        F.when(F.col("verdict").isNull(), "model").otherwise("rule").alias("decided_by"),
    )


def query(spark, folder: str) -> DataFrame:
    return judged(table(spark, folder, "pages"))


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u, regexp_extract(coalesce(url, ''), '^[\s\S]*?://([\s\S]*)$', 1) AS a
  FROM pages),
h AS (
  SELECT page_id, u, translate(regexp_extract(a, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(a, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM p),
rules(kind, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hit AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(kind, length(rh || rp)) AS v
  FROM h JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY page_id),
r AS (
  SELECT h.*, rule, v, substr(md5(u), 1, 1) IN ('0', '1', '2') AS held,
         translate(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^abcdefghijklmnopqrstuvwxyz0-9./-]', '_', 'g'), '123456789', '000000000') AS f
  FROM h LEFT JOIN hit USING (page_id)),
s AS (
  SELECT *, list_concat([0, 0, 0], list_transform(string_split(f, ''),
         lambda c: instr('abcdefghijklmnopqrstuvwxyz0./-_', c)), [0]) AS k FROM r),
w AS (
  SELECT page_id, v, held, k[i] * 32768 + k[i + 1] * 1024 + k[i + 2] * 32 + k[i + 3] AS code
  FROM (SELECT *, unnest(range(1, len(k) - 2)) AS i FROM s)),
c AS (
  SELECT code, count(*) FILTER (v = 'allow' AND NOT held) AS y, count(*) FILTER (v = 'block' AND NOT held) AS n
  FROM w GROUP BY code),
g1 AS (SELECT code % 32 AS g, sum(y) AS y, sum(n) AS n FROM c GROUP BY 1),
g2 AS (SELECT code % 1024 AS g, sum(y) AS y, sum(n) AS n FROM c GROUP BY 1),
g3 AS (SELECT code % 32768 AS g, sum(y) AS y, sum(n) AS n FROM c GROUP BY 1),
c1 AS (SELECT sum(y) AS y, sum(n) AS n FROM c),
c2 AS (SELECT code % 1024 // 32 AS g, sum(y) AS y, sum(n) AS n FROM c GROUP BY 1),
c3 AS (SELECT code % 32768 // 32 AS g, sum(y) AS y, sum(n) AS n FROM c GROUP BY 1),
c4 AS (SELECT code // 32 AS g, sum(y) AS y, sum(n) AS n FROM c GROUP BY 1),
q AS (
  SELECT c.code,
    (c.y + 4 * (g3.y + 4 * (g2.y + 4 * (g1.y + 4 * (1 / 32::DOUBLE)) / (c1.y + 4)) / (c2.y + 4)) / (c3.y + 4)) / (c4.y + 4)::DOUBLE AS py,
    (c.n + 4 * (g3.n + 4 * (g2.n + 4 * (g1.n + 4 * (1 / 32::DOUBLE)) / (c1.n + 4)) / (c2.n + 4)) / (c3.n + 4)) / (c4.n + 4)::DOUBLE AS pn
  FROM c JOIN g1 ON g1.g = c.code % 32 JOIN g2 ON g2.g = c.code % 1024 JOIN g3 ON g3.g = c.code % 32768
  JOIN c2 ON c2.g = c.code % 1024 // 32 JOIN c3 ON c3.g = c.code % 32768 // 32 JOIN c4 ON c4.g = c.code // 32
  JOIN c1 ON true),
sc AS (SELECT page_id, round(avg(ln(py) - ln(pn)), 9) AS score FROM w JOIN q USING (code) GROUP BY page_id),
m AS (
  SELECT avg(score) FILTER (v = 'allow') AS my, stddev_pop(score) FILTER (v = 'allow') + 1e-9 AS sy,
         avg(score) FILTER (v = 'block') AS mn, stddev_pop(score) FILTER (v = 'block') + 1e-9 AS sn
  FROM r JOIN sc USING (page_id) WHERE held AND v IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN score >= least(0, (my * sn + mn * sy) / (sy + sn))
       THEN 'allow' ELSE 'block' END) AS verdict, score, CASE WHEN v IS NULL THEN 'model' ELSE 'rule' END AS decided_by
FROM r JOIN sc USING (page_id) JOIN m ON true
"""

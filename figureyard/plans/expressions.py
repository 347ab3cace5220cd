"""Scalar expressions over whole tables."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from figureyard import schemas
from figureyard.functions import columns as c
from figureyard.functions import replies
from figureyard.functions.vectors import argmax, dot, norm, softmax_scores, unit_vector
from figureyard.plans.catalog import query
from figureyard.sources import tables as t


@query(
    "sc1_base_ids",
    "SELECT doc_id, arxiv_id, regexp_replace(arxiv_id, 'v[0-9]+$', '') AS base FROM papers_v",
)
def base_ids(spark, d):
    return t.papers(spark, d).select("doc_id", "arxiv_id", c.base_id(F.col("arxiv_id")).alias("base"))


@query(
    "sc2_names",
    """
    SELECT image_id, replace(field || '/' || arxiv_id, '/', '_') || '_p' || lpad(CAST(page_no AS VARCHAR), 3, '0') AS page,
           replace(arxiv_id, '/', '_') || '_p' || lpad(CAST(page_no AS VARCHAR), 3, '0') || '_'
             || printf('%02d', image_id % 90) AS crop,
           'batch_' || printf('%05d', image_id % 1000) AS batch
    FROM images_v
    """,
)
def names(spark, d):
    aid = F.concat_ws("/", "field", "arxiv_id")
    return t.images(spark, d).select(
        "image_id",
        c.page_name(aid, F.col("page_no")).alias("page"),
        c.crop_name(F.col("arxiv_id"), F.col("page_no"), F.col("image_id") % 90).alias("crop"),
        c.batch_name(F.col("image_id") % 1000).alias("batch"),
    )


@query(
    "sc3_squeezed_text",
    """
    SELECT doc_id, md5(sq) AS digest, substr(sq, 1, 800) AS cut, length(sq) AS n
    FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS sq FROM documents)
    """,
)
def squeezed_text(spark, d):
    sq = c.squeeze(F.col("text"))
    return t.table(spark, d, "documents").select("doc_id", sq.alias("sq")).select(
        "doc_id", F.md5("sq").alias("digest"), F.substring("sq", 1, c.CAPTION_CHARS).alias("cut"),
        F.length("sq").cast("bigint").alias("n"),
    )


@query(
    "sc4_truncation",
    """
    SELECT doc_id, md5(substr(text, 1, 500)) AS error, md5(substr(text, 1, 200)) AS reason,
           md5(substr(text, 1, 4000)) AS ocr, substr(text, 1, 40) AS prefix FROM documents
    """,
)
def truncation(spark, d):
    def cut(n):
        return F.substring("text", 1, n)

    return t.table(spark, d, "documents").select(
        "doc_id", F.md5(cut(c.ERROR_CHARS)).alias("error"), F.md5(cut(c.REASON_CHARS)).alias("reason"),
        F.md5(cut(c.OCR_CHARS)).alias("ocr"), cut(c.PREFIX_CHARS).alias("prefix"),
    )


@query(
    "sc5_joined_names",
    """
    SELECT p_partkey, array_to_string(string_split(p_name, ' '), '; ') AS names FROM part
    """,
)
def joined_names(spark, d):
    return t.table(spark, d, "part").select(
        "p_partkey", c.joined(F.split("p_name", " ")).alias("names")
    )


@query(
    "sc6_scrubbed_text",
    """
    SELECT page_id, md5(regexp_replace(html, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) AS digest FROM pages
    """,
)
def scrubbed_text(spark, d):
    return t.table(spark, d, "pages").select("page_id", F.md5(c.scrub(F.col("html"))).alias("digest"))


@query(
    "sc7_parsed_replies",
    """
    SELECT doc_id, CASE WHEN ok THEN doc_id % 2 = 0 END AS is_diagram, CASE WHEN ok THEN '' END AS reject_reason,
           CASE WHEN ok THEN '' END AS diagram_type,
           CASE WHEN ok THEN replace(replace(text, '"', ''), chr(92), '')
                || CASE doc_id % 3 WHEN 0 THEN chr(92) || 'alpha' WHEN 1 THEN chr(92) || 'frac' ELSE chr(10) END END AS title,
           CASE WHEN ok THEN '' END AS label, CASE WHEN NOT ok THEN 'no JSON object' END AS parse_error
    FROM (SELECT doc_id, text, doc_id % 5 <> 2 AS ok FROM documents)
    """,
)
def parsed_replies(spark, d):
    """Replies built from document text in the ways models garble JSON."""
    text = F.replace("text", F.lit('"'), F.lit(""))
    text = F.replace(text, F.lit("\\"), F.lit(""))
    body = F.concat(
        F.lit('{"is_diagram": '), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false"),
        F.lit(', "title": "'), text,
        F.when(F.col("doc_id") % 3 == 0, F.lit("\\alpha")).when(F.col("doc_id") % 3 == 1, F.lit("\\frac"))
        .otherwise("\n"),
        F.lit('"}'),
    )
    reply = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone")))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("I think "), body, F.lit(" is right")))
        .when(F.col("doc_id") % 5 == 2, F.lit("no object here"))
        .otherwise(body)
    )
    rows = t.table(spark, d, "documents").select("doc_id", reply.alias("reply"))
    parsed = replies.parse_replies(rows, "reply", schemas.LABEL_REPLY, replies.LABEL_DEFAULTS)
    return parsed.select("doc_id", "parsed.*", "parse_error")


@query(
    "sc8_request_texts",
    """
    SELECT doc_id, md5('Page ' || page || ' of "' || title || '" (' || field || ')\n' || 'Text:\n'
             || CASE WHEN length(trim(source)) > 0 THEN trim(source) ELSE '(no OCR text available)' END
             || '\nFigures:\n' || trim(ctx)) AS digest
    FROM (SELECT doc_id, doc_id % n_pages + 1 AS page, title, field,
                 CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE source END AS source,
                 '- ' || lower(field) || ': ' || source || '\n- diagram: '
                 || CASE WHEN doc_id % 2 = 0 THEN '\nPage summary: ' || status ELSE '' END AS ctx
          FROM papers_v)
    """.replace("\\n", "' || chr(10) || '").replace("\n' ||", "\n' ||"),
)
def request_texts(spark, d):
    diagrams = F.array(
        F.struct(F.lower("field").alias("type"), F.col("source").alias("description")),
        F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("description")),
    )
    summary = F.when(F.col("doc_id") % 2 == 0, F.col("status"))
    ocr = F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("source"))
    text = replies.request_text(
        F.col("doc_id") % F.col("n_pages") + 1, F.col("title"), F.col("field"), ocr,
        replies.context_lines(diagrams, summary),
    )
    return t.papers(spark, d).select("doc_id", F.md5(text).alias("digest"))


@query(
    "sc9_data_uris",
    """
    SELECT conv_id, turn, md5('data:image/jpeg;base64,' || base64(encode(text))) AS uri, md5(text) AS payload
    FROM conversations
    """,
)
def data_uris(spark, d):
    uri = c.data_uri(c.media_type(F.lit("x.JPG")), F.encode("text", "UTF-8"))
    # base64 of Spark breaks lines by default in some settings; compare without
    flat = F.regexp_replace("uri", "[\r\n]", "")
    return t.table(spark, d, "conversations").select("conv_id", "turn", uri.alias("uri")).select(
        "conv_id", "turn", F.md5(flat).alias("uri"),
        F.md5(c.data_uri_bytes(F.col("uri"))).alias("payload"),
    )


@query(
    "sc10_rect_json",
    """
    SELECT page_key, x0, y0, x1, y1, '[' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || ']' AS bbox, y1 AS last
    FROM rects_v
    """,
)
def rect_json(spark, d):
    text = c.rect_json(*[F.col(s) for s in ("x0", "y0", "x1", "y1")])
    return t.rects(spark, d).withColumn("bbox", text).select(
        "page_key", "x0", "y0", "x1", "y1", "bbox", F.get(c.rect_from_json(F.col("bbox")), 3).alias("last")
    )


@query(
    "sc11_rect_measures",
    """
    SELECT page_key, x0, y0, x1, y1,
           round(greatest(x1 - x0, y1 - y0) / greatest(1, least(x1 - x0, y1 - y0))::DOUBLE, 6) AS aspect,
           round((x1 - x0) * (y1 - y0) / (612 * 792)::DOUBLE, 6) AS share,
           greatest(0, least(x1, 306) - x0) * greatest(0, least(y1, 396) - y0) AS in_first_quarter
    FROM rects_v
    """,
)
def rect_measures(spark, d):
    r = {s: F.col(s) for s in ("x0", "y0", "x1", "y1")}
    quarter = {"x0": F.lit(0), "y0": F.lit(0), "x1": F.lit(306), "y1": F.lit(396)}
    return t.rects(spark, d).select(
        "page_key", *r,
        F.round(c.aspect(r["x1"] - r["x0"], r["y1"] - r["y0"]), 6).alias("aspect"),
        F.round(c.area(**r) / F.lit(t.PAGE_W * t.PAGE_H), 6).alias("share"),
        c.intersection(r, quarter).alias("in_first_quarter"),
    )


@query(
    "sc12_unit_vectors",
    """
    SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 2) AS before,
           1.0::DOUBLE AS after FROM embeddings
    """,
)
def unit_vectors(spark, d):
    e = t.table(spark, d, "embeddings")
    return e.withColumn("u", unit_vector("embedding")).select(
        "vec_id", F.round(dot(F.col("embedding"), F.col("embedding")), 2).alias("before"),
        F.round(norm(F.col("u")), 4).alias("after"),
    )


@query(
    "sc12_mean_vectors",
    """
    SELECT label, j AS d, round(avg(CAST(embedding[j + 1] AS DOUBLE)), 4) AS mean
    FROM embeddings, range(0, 64) r(j) GROUP BY label, j
    """,
)
def mean_vectors(spark, d):
    e = t.table(spark, d, "embeddings")
    means = e.groupBy("label").agg(Summarizer.mean(array_to_vector("embedding")).alias("m"))
    return means.select("label", F.posexplode(vector_to_array("m")).alias("d", "x")).select(
        "label", "d", F.round("x", 4).alias("mean")
    )


@query(
    "sc13_softmax",
    """
    SELECT image_id, round(a / (a + b), 6) AS share_a, round(b / (a + b), 6) AS share_b,
           CASE WHEN a >= b THEN 0 ELSE 1 END AS best
    FROM (SELECT image_id, exp(10 * p_diagram) AS a, exp(10 * (1 - p_diagram)) AS b FROM preds_v)
    """,
)
def softmax(spark, d):
    scores = F.array(F.col("p_diagram"), 1 - F.col("p_diagram"))
    share = softmax_scores(scores)
    return t.predictions(spark, d).select(
        "image_id", F.round(F.get(share, 0), 6).alias("share_a"),
        F.round(F.get(share, 1), 6).alias("share_b"), argmax(scores).alias("best"),
    )


@query(
    "sc14_class_names",
    """
    SELECT image_id, ['diagram', 'data_plot', 'photo', 'fragment_junk'][y4 + 1] AS cls, y4 AS idx,
           CASE field WHEN 'f0' THEN 'Field 0' ELSE field END AS shown FROM preds_v
    """,
)
def class_names(spark, d):
    p = t.predictions(spark, d).withColumn("cls", c.class_name(F.col("y4")))
    return p.select(
        "image_id", "cls", c.class_index(F.col("cls")).alias("idx"),
        c.display_name(F.col("field"), {"f0": "Field 0"}).alias("shown"),
    )


@query(
    "sc15_digests",
    "SELECT doc_id, substr(sha256(text), 1, 16) AS digest FROM documents",
)
def digests(spark, d):
    return t.table(spark, d, "documents").select("doc_id", c.digest16(F.col("text")).alias("digest"))


@query(
    "sc16_half_even",
    """
    SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 0) AS r0, round_even(l_quantity * 0.125, 2) AS r2
    FROM lineitem
    """,
)
def half_even(spark, d):
    q = F.col("l_quantity")
    return t.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", c.rounded(q / 4, 0).alias("r0"), c.rounded(q * 0.125, 2).alias("r2")
    )


@query(
    "sc17_epochs",
    """
    SELECT event_id, epoch_us(ts) // 1000 AS millis, strftime(ts, '%Y-%m-%d') AS day FROM events
    """,
)
def epochs(spark, d):
    ts = c.utc_instant(F.col("ts"))
    back = F.timestamp_millis(F.unix_millis(ts))
    return t.table(spark, d, "events").select(
        "event_id", F.unix_millis(ts).alias("millis"), F.date_format(c.utc_day(back), "yyyy-MM-dd").alias("day")
    )


# Categories and words of each subject: rules of the row tagger.
RULES = [
    ("0", "numbers", ["en", "de"], ["data", "system", "model"]),
    ("1", "places", ["en", "fr", "es"], ["city", "river", "market"]),
    ("2", "any_english", ["en"], []),
]


@query(
    "sc18_rule_tags",
    """
    SELECT doc_id,
           CASE WHEN lang IN ('en', 'de') AND regexp_matches(lower(text), 'data|system|model') THEN 'numbers'
                WHEN lang IN ('en', 'fr', 'es') AND regexp_matches(lower(text), 'city|river|market') THEN 'places'
                WHEN lang IN ('en') THEN 'any_english' END AS subject
    FROM documents
    """,
)
def rule_tags(spark, d):
    # a handful of rules, kept as one expression: the first match wins
    subject = F
    for _, name, langs, words in RULES:
        rule = F.arrays_overlap(F.array("lang"), F.array(*[F.lit(x) for x in langs]))
        if words:
            rule = rule & F.lower("text").rlike("|".join(words))
        subject = subject.when(rule, name)
    return t.table(spark, d, "documents").select("doc_id", subject.alias("subject"))


@query(
    "sc19_object_keys",
    """
    SELECT image_id, 'v3/img/' || field || '/' || image_id || '.png' AS key, field || '/' || image_id || '.png' AS entry
    FROM images_v
    """,
)
def object_keys(spark, d):
    url = F.concat(F.lit("img/"), "field", F.lit("/"), F.col("image_id").cast("string"), F.lit(".png"))
    key = c.object_key(url)
    return t.images(spark, d).select(
        "image_id", key.alias("key"), c.archive_entry(F.col("field"), key).alias("entry")
    )


@query(
    "sc20_failure_classes",
    """
    SELECT event_id, CASE code WHEN 402 THEN 'fatal' WHEN 429 THEN 'retry' WHEN 500 THEN 'retry' WHEN 502 THEN 'retry'
                     WHEN 503 THEN 'retry' WHEN 504 THEN 'retry' WHEN 200 THEN 'ok' ELSE 'final' END AS outcome
    FROM (SELECT event_id, [200, 402, 404, 429, 500, 502, 503, 504][1 + event_id % 8] AS code FROM events)
    """,
)
def failure_classes(spark, d):
    codes = F.array(*[F.lit(x) for x in (200, 402, 404, 429, 500, 502, 503, 504)])
    code = F.get(codes, (F.col("event_id") % 8).cast("int"))
    return t.table(spark, d, "events").select("event_id", c.failure_class(code).alias("outcome"))

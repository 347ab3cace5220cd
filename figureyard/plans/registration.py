"""Registration, queues, requeue and decision-log queries."""

from pyspark.sql import functions as F

from figureyard.functions.columns import base_id, data_uri_bytes, page_name
from figureyard.operators import batching, gates, registry
from figureyard.operators.ranking import id_bucket
from figureyard.plans.catalog import query
from figureyard.sources import scans
from figureyard.sources import tables as t

PAGE_CAP = 20  # pages registered of a document


@query(
    "reg1_register_first_wins",
    """
    SELECT base_id, arxiv_id, field, doc_id FROM (
      SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY doc_id) AS rn FROM papers_v
      WHERE status <> 'downloaded') b
    WHERE rn = 1 AND base_id NOT IN (SELECT base_id FROM papers_v WHERE status = 'downloaded')
    """,
)
def register_first_wins(spark, d):
    p = t.papers(spark, d)
    known = p.filter(F.col("status") == "downloaded").select("base_id")
    batch = p.filter(F.col("status") != "downloaded").select(
        base_id(F.col("arxiv_id")).alias("base_id"), "arxiv_id", "field", "doc_id"
    )
    return registry.register_first_wins(batch, known, "doc_id")


@query(
    "reg1_registered_count",
    """
    SELECT field, count(*) AS added FROM (
      SELECT base_id, arg_min(field, doc_id) AS field FROM papers_v GROUP BY base_id)
    GROUP BY field
    """,
)
def registered_count(spark, d):
    p = t.papers(spark, d).select("base_id", "arxiv_id", "field", "doc_id")
    new = registry.register_first_wins(p, p.limit(0), "doc_id")
    return new.groupBy("field").agg(F.count(F.lit(1)).alias("added"))


@query(
    "reg2_harvest_in_order",
    """
    SELECT base_id, doc_id FROM (
      SELECT base_id, min(doc_id) AS doc_id FROM papers_v GROUP BY base_id)
    ORDER BY doc_id LIMIT 500
    """,
)
def harvest_in_order(spark, d):
    p = t.papers(spark, d).select("base_id", "doc_id")
    return registry.harvest_in_order(p, "base_id", "doc_id", 500)


@query(
    "reg3_page_explosion",
    """
    SELECT p.arxiv_id, p.page_no FROM (
      SELECT arxiv_id, CAST(unnest(range(1, least(n_pages, 20) + 1)) AS INT) AS page_no FROM papers_v
      WHERE status <> 'failed') p
    LEFT JOIN (SELECT arxiv_id, page_no FROM pages_v WHERE screen_pos) g
      ON g.arxiv_id = p.arxiv_id AND g.page_no = p.page_no
    WHERE g.arxiv_id IS NULL
    """,
)
def page_explosion(spark, d):
    p = t.papers(spark, d).filter(F.col("status") != "failed")
    known = t.pages(spark, d).filter("screen_pos")
    return registry.explode_pages(p, known, PAGE_CAP)


@query(
    "reg4_pending_pages",
    """
    SELECT g.arxiv_id, g.page_no, g.field, p.title FROM pages_v g
    JOIN papers_v p ON p.arxiv_id = g.arxiv_id
    WHERE NOT g.screen_pos AND NOT (g.page_no = 2)
    ORDER BY g.arxiv_id, g.page_no LIMIT 300
    """,
)
def pending_pages(spark, d):
    g = t.pages(spark, d)
    flying = g.filter(F.col("page_no") == 2)
    # the queue is cut to its limit before the title is joined
    queue = registry.work_queue(
        g, ~F.col("screen_pos"), flying, ["arxiv_id", "page_no"],
        [F.col("arxiv_id"), F.col("page_no")], 300,
    ).select("arxiv_id", "page_no", "field")
    return queue.join(t.papers(spark, d).select("arxiv_id", "title"), "arxiv_id")


@query(
    "reg4_screened_pages",
    """
    SELECT arxiv_id, page_no, field FROM pages_v WHERE has_graphics AND screen_pos
    ORDER BY arxiv_id, page_no LIMIT 300
    """,
)
def screened_pages(spark, d):
    return registry.work_queue(
        t.pages(spark, d), F.col("has_graphics") & F.col("screen_pos"), None,
        ["arxiv_id", "page_no"], [F.col("arxiv_id"), F.col("page_no")], 300,
    ).select("arxiv_id", "page_no", "field")


@query(
    "reg4_pending_images",
    """
    SELECT image_id, arxiv_id, page_no FROM images_v WHERE status = 'pending'
    ORDER BY image_id LIMIT 200
    """,
)
def pending_images(spark, d):
    return registry.work_queue(
        t.images(spark, d), F.col("status") == "pending", None,
        ["image_id"], [F.col("image_id")], 200,
    ).select("image_id", "arxiv_id", "page_no")


@query(
    "reg5_remaining_by_document",
    """
    SELECT arxiv_id, string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) AS page_list,
           CAST(count(*) AS INT) AS n
    FROM pages_v WHERE NOT screen_pos GROUP BY arxiv_id
    """,
)
def remaining_by_document(spark, d):
    g = t.pages(spark, d)
    out = registry.remaining_by_document(
        g, g.filter("screen_pos"), "arxiv_id", ["arxiv_id", "page_no"]
    )
    return out.select(
        "arxiv_id",
        F.array_join(F.transform("page_list", lambda x: x.cast("string")), ",").alias("page_list"),
        F.size("page_list").alias("n"),
    )


@query(
    "reg6_requeue_failed",
    """
    SELECT 'pages' AS entity, count(*) FILTER (s IN ('failed', 'processing')) AS requeued,
           count(*) FILTER (s IN ('failed', 'processing', 'pending')) AS pending,
           count(*) FILTER (s IN ('failed', 'done')) AS had_error, count(*) FILTER (s = 'done') AS has_error
    FROM (SELECT CASE (doc_id + page_no) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' WHEN 2 THEN 'pending'
                 ELSE 'done' END AS s FROM pages_v)
    UNION ALL
    SELECT 'batches', count(*) FILTER (status = 'failed' AND cost > 10),
           count(*) FILTER (status = 'pending' OR (status = 'failed' AND cost > 10)),
           count(*) FILTER (status = 'failed'), count(*) FILTER (status = 'failed' AND NOT coalesce(cost > 10, false))
    FROM decisions_v
    """,
)
def requeue_failed(spark, d):
    """Pages that failed or were being worked on, and failed batches that were
    built; papers stay failed."""

    def counts(name, before, **how):
        return registry.requeue_failed(before.withColumn("had", F.col("error")), **how).agg(
            F.lit(name).alias("entity"),
            F.count_if("requeued").alias("requeued"),
            F.count_if(F.col("status") == "pending").alias("pending"),
            F.count("had").alias("had_error"), F.count("error").alias("has_error"),
        )

    turn = (F.col("doc_id") + F.col("page_no")) % 4
    state = (
        F.when(turn == 0, "failed").when(turn == 1, "processing").when(turn == 2, "pending")
        .otherwise("done")
    )
    wrong = F.when(F.col("status").isin("failed", "done"), "some error")
    pages = t.pages(spark, d).withColumn("status", state).withColumn("error", wrong)
    built = t.decisions(spark, d).withColumn("error", F.when(F.col("status") == "failed", "x"))
    return counts("pages", pages, interrupted="processing").unionByName(
        counts("batches", built, needs=F.col("cost") > 10)
    )


@query(
    "reg6_lost_assets",
    """
    SELECT image_id, CASE WHEN status = 'pending' AND file_bytes < 2000 THEN 'lost'
                          WHEN status = 'pending' THEN 'local' ELSE status END AS status
    FROM images_v
    """,
)
def lost_assets(spark, d):
    images = t.images(spark, d).withColumn(
        "status", F.when(F.col("status") == "pending", "local").otherwise(F.col("status"))
    )
    listing = images.filter(F.col("file_bytes") >= 2000).select("image_id")
    return registry.requeue_assets(images, listing, "image_id").select("image_id", "status")


_LOG_SQL = """
    SELECT entity, max_by(status, seq) AS status, substr(max_by(repeat(stage, 100), seq), 1, 500) AS error, {cost} AS cost,
           count(*) FILTER (status = 'failed') AS failures, count(*) AS steps
    FROM decisions_v GROUP BY entity
"""


@query("reg7_fold_page_log", _LOG_SQL.format(cost="round(sum(cost), 4)"))
def fold_page_log(spark, d):
    log = t.decisions(spark, d).withColumn("error", F.repeat("stage", 100))
    return registry.fold_log(log, "entity", "seq", "cost", accumulate=True).select(
        "entity", "status", "error", F.round("cost", 4).alias("cost"), "failures", "steps"
    )


@query("reg7_fold_image_log", _LOG_SQL.format(cost="round(max_by(cost, seq), 4)"))
def fold_image_log(spark, d):
    log = t.decisions(spark, d).withColumn("error", F.repeat("stage", 100))
    return registry.fold_log(log, "entity", "seq", "cost", accumulate=False).select(
        "entity", "status", "error", F.round("cost", 4).alias("cost"), "failures", "steps"
    )


def page_verdicts(spark, d):
    g = t.pages(spark, d)
    return g.select(
        "arxiv_id", "doc_id", "field", "page_no",
        F.when(~F.col("has_graphics"), False).when(~F.col("screen_pos"), False)
        .otherwise(F.col("confirm_pos")).alias("has_diagram"),
        F.when(~F.col("has_graphics"), 0.0).when(~F.col("screen_pos"), F.col("screen_cost"))
        .otherwise(F.col("screen_cost") + F.col("confirm_cost")).alias("cost"),
    )


@query(
    "reg8_screen_then_confirm",
    "SELECT arxiv_id, page_no, has_diagram, cost FROM verdicts_v",
)
def screen_then_confirm(spark, d):
    g = t.pages(spark, d)
    keys = ["arxiv_id", "page_no"]
    screens = g.filter("has_graphics").select(*keys, "screen_pos", "screen_cost")
    confirms = g.filter("has_graphics AND screen_pos").select(*keys, "confirm_pos", "confirm_cost")
    return gates.page_verdict(
        g.select(*keys, "has_graphics"), screens, confirms, keys
    ).select(*keys, "has_diagram", "cost")


@query(
    "reg9_accept_or_reject",
    """
    SELECT image_id,
           CASE WHEN toxic = 0 AND length(trim(label)) > 0 THEN 'labeled' ELSE 'rejected' END AS status,
           CASE WHEN toxic = 0 AND length(trim(label)) > 0 THEN ''
                ELSE 'llm:' || CASE WHEN trim(reason) = '' THEN 'not-a-diagram' ELSE trim(reason) END
           END AS reject_reason
    FROM (SELECT image_id, coalesce(toxic, 1) AS toxic,
                 CASE WHEN width > 500 THEN '  ' ELSE 'a figure' END AS label,
                 CASE WHEN height > 400 THEN ' ' ELSE ' ' || field || ' plot ' END AS reason
          FROM images_v)
    """,
)
def accept_or_reject(spark, d):
    i = t.images(spark, d)
    label = F.when(F.col("width") > 500, "  ").otherwise("a figure")
    reason = F.when(F.col("height") > 400, " ").otherwise(
        F.concat(F.lit(" "), "field", F.lit(" plot "))
    )
    return i.select("image_id", "toxic", label.alias("label"), reason.alias("reason")).select(
        "image_id",
        *[
            c.alias(n)
            for n, c in gates.crop_decision(
                F.col("toxic") == 0, F.col("label"), F.col("reason")
            ).items()
        ],
    )


@query(
    "reg10_gate_accept",
    """
    SELECT image_id, replace(arxiv_id, '/', '_') || '_p' || lpad(CAST(page_no AS VARCHAR), 3, '0')
             || '_image_' || lpad(CAST(ordinal AS VARCHAR), 2, '0') AS name
    FROM (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY page_no, image_id) AS ordinal
          FROM (SELECT i.*, regexp_replace(arxiv_id, 'v[0-9]+$', '') AS base_id FROM images_v i)
          WHERE status <> 'rejected' AND (image_id * 37) % 100 / CAST(100 AS DOUBLE) >= 0.5)
    """,
)
def gate_accept(spark, d):
    i = t.images(spark, d).select(
        "image_id", "page_no", "arxiv_id", base_id(F.col("arxiv_id")).alias("base_id"),
        F.when(F.col("status") != "rejected", "diagram").otherwise("photo").alias("cls"),
        ((F.col("image_id") * 37) % 100 / F.lit(100.0)).alias("p"),
    )
    kept = gates.gate_accept(
        i, 0.5, "base_id", [F.col("page_no"), F.col("image_id")],
        [F.col("page_no"), id_bucket(F.col("image_id"))],
    )
    name = F.format_string(
        "%s_image_%02d", page_name(F.col("arxiv_id"), F.col("page_no")), F.col("ordinal")
    )
    return kept.select("image_id", name.alias("name"))


@query(
    "reg11_fallback_asset",
    """
    SELECT g.arxiv_id, g.page_no,
           coalesce(CAST(i.image_id AS VARCHAR), 'page:' || g.arxiv_id) AS item
    FROM pages_v g LEFT JOIN images_v i ON i.arxiv_id = g.arxiv_id AND i.page_no = g.page_no
    WHERE g.screen_pos
    """,
)
def fallback_asset(spark, d):
    g = t.pages(spark, d).filter("screen_pos").select(
        "arxiv_id", "page_no", F.col("arxiv_id").alias("page_asset")
    )
    crops = t.images(spark, d).select(
        "arxiv_id", "page_no", F.col("image_id").cast("string").alias("crop")
    )
    return gates.fallback_assets(g, crops, ["arxiv_id", "page_no"], "crop").select(
        "arxiv_id", "page_no", "item"
    )


@query(
    "reg12_fold_ocr",
    """
    SELECT doc_id AS batch_id, arxiv_id, page_no, ordinal, 'img-' || ordinal || '.png' AS image_name,
           text AS payload
    FROM (SELECT doc_id, arxiv_id, text, unnest(range(1, n_pages + 1)) AS page_no
          FROM papers_v JOIN documents USING (doc_id)), (VALUES (1), (3)) b(ordinal)
    """,
)
def fold_ocr(spark, d):
    # the whole text is the payload
    p = t.papers(spark, d, "text")
    uri = F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("text", "UTF-8")))

    def response_of(uri):
        images = F.transform(
            F.sequence(F.lit(1), F.lit(3)),
            lambda o: F.struct(
                F.concat(F.lit("img-"), o.cast("string"), F.lit(".png")).alias("id"),
                F.when(o != 2, uri).alias("image_base64"),
            ),
        )
        # the response holds two pages more than the manifest
        return F.struct(
            F.transform(
                F.sequence(F.lit(0), F.col("n_pages") + 1),
                lambda i: F.struct(
                    i.alias("index"), F.lit("").alias("markdown"), images.alias("images")
                ),
            ).alias("pages")
        )

    # encoded once for all pages
    response = F.get(F.transform(F.array(uri), response_of), F.lit(0))
    manifest = F.transform(
        F.sequence(F.lit(1), F.col("n_pages")),
        lambda n: F.struct(F.col("arxiv_id").alias("arxiv_id"), n.alias("page_no")),
    )
    batches = p.select(F.col("doc_id").alias("batch_id"), manifest.alias("manifest"),
                       response.alias("response"))
    return scans.fold_ocr(batches, "manifest", "response").select(
        "batch_id", "arxiv_id", "page_no", "ordinal", "image_name",
        F.decode(data_uri_bytes(F.col("uri")), "UTF-8").alias("payload"),
    )


@query(
    "reg13_quota_per_field",
    """
    SELECT field, doc_id, rn FROM (
      SELECT field, doc_id, row_number() OVER (PARTITION BY field ORDER BY doc_id) AS rn
      FROM papers_v WHERE status = 'downloaded') WHERE rn <= 40
    """,
)
def quota_per_field(spark, d):
    p = t.papers(spark, d).filter(F.col("status") == "downloaded").select("field", "doc_id")
    return registry.quota(p, "field", [F.col("doc_id")], 40)


@query(
    "reg13_quota_shortage",
    """
    SELECT source, least(n, 60) AS taken, 60 - least(n, 60) AS missing FROM (
      SELECT source, count(*) FILTER (status = 'downloaded') AS n FROM papers_v GROUP BY source)
    """,
)
def quota_shortage(spark, d):
    p = t.papers(spark, d).select("source", "doc_id", "status")
    got = p.filter(F.col("status") == "downloaded")
    taken = registry.quota(got, "source", [F.col("doc_id")], 60)
    return registry.quota_shortage(taken, p, "source", 60)


@query(
    "reg14_split_manifest",
    """
    SELECT arxiv_id, page_no, page_no <= n_pages AS valid, CASE WHEN page_no <= n_pages THEN 0 ELSE -1 END AS batch_id
    FROM (SELECT arxiv_id, n_pages, CAST(unnest(range(1, n_pages + 3)) AS INT) AS page_no FROM papers_v)
    """,
)
def split_manifest(spark, d):
    p = t.papers(spark, d)
    wanted = p.select(
        "arxiv_id",
        F.explode(F.sequence(F.lit(1), F.col("n_pages") + 2)).alias("page_no"),
    )
    docs = p.select("arxiv_id", F.col("n_pages").alias("page_count"))
    return registry.split_manifest(wanted, docs).select("arxiv_id", "page_no", "valid", "batch_id")


def _halving_sql(rounds: int, cap: int) -> str:
    """Chunks of 50, then ``rounds`` halvings, unrolled as nested selects."""
    sql = """
      SELECT field, arxiv_id, page_no, bytes, pos, (pos - 1) // 50 AS chunk, '' AS part FROM (
        SELECT field, arxiv_id, page_no, (doc_id * 7919 + page_no * 104729) % 900000 AS bytes,
               row_number() OVER (PARTITION BY field ORDER BY doc_id, page_no) AS pos
        FROM pages_v WHERE screen_pos)"""
    for _ in range(rounds):
        sql = f"""
      SELECT field, arxiv_id, page_no, bytes, pos, chunk,
             CASE WHEN b > {cap} AND n > 1 THEN part || CASE WHEN i <= n // 2 THEN '0' ELSE '1' END
                  ELSE part END AS part
      FROM (SELECT *, sum(bytes) OVER (PARTITION BY field, chunk, part) AS b,
                   count(*) OVER (PARTITION BY field, chunk, part) AS n,
                   row_number() OVER (PARTITION BY field, chunk, part ORDER BY pos) AS i
            FROM ({sql}))"""
    return f"""
      SELECT field, chunk, part, count(*) AS n_pages, CAST(sum(bytes) AS BIGINT) AS bytes,
             min(pos) AS first_pos FROM ({sql}) GROUP BY field, chunk, part"""


@query("reg15_page_batches", _halving_sql(6, 6_000_000))
def page_batches(spark, d):
    g = t.pages(spark, d).filter("screen_pos").select(
        "field", "arxiv_id", "doc_id", "page_no",
        ((F.col("doc_id") * 7919 + F.col("page_no") * 104729) % 900000).alias("bytes"),
    )
    doc = F.col("doc_id")
    cut = batching.page_batches(
        g, "field", [doc, F.col("page_no")], [id_bucket(doc, 2048)], 50, 6_000_000
    )
    return cut.groupBy("field", "chunk", "part").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("bytes").alias("bytes"),
        F.min("pos").alias("first_pos"),
    )


@query(
    "reg16_bookkeeping",
    """
    SELECT stage, max_by(entity, seq) AS latest, min_by(entity, seq) AS first
    FROM decisions_v GROUP BY stage
    """,
)
def bookkeeping(spark, d):
    return registry.bookkeeping(t.decisions(spark, d), "stage", "entity", "seq")

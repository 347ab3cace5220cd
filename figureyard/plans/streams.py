"""Streaming queries, run over everything available and read back as tables."""

from pyspark.sql import functions as F

from figureyard.functions.columns import utc_instant
from figureyard.operators.ranking import id_bucket, rank_within
from figureyard.plans.catalog import query
from figureyard.plans.joining import positioned_manifest
from figureyard.plans.registration import _LOG_SQL
from figureyard.plans.storage import _GALLERY, ARCHIVE_CAP, ARCHIVE_SQL, gallery_images
from figureyard.schemas import TABLES
from figureyard.session import materialised, shared_path
from figureyard.sinks import stores
from figureyard.sources import tables as t
from figureyard.streaming import intake, jobs


def _arriving(spark, df, order, parts=3):
    """``df`` as a feed whose files arrive in ``order``, a third at a time."""
    path = shared_path(spark, "arrivals")
    top = df.agg(F.max(order)).first()[0] or 0

    def write(i):
        lo, hi = (top + 1) * i // parts, (top + 1) * (i + 1) // parts
        part = df.filter((F.col(order) >= lo) & (F.col(order) < hi))
        part.write.mode("append").parquet(path)

    write(0)  # the folder has to exist before the stream is defined
    later = [lambda i=i: write(i) for i in range(1, parts)]
    return jobs.Feed(jobs.file_stream(spark, path, df.schema), [lambda: None, *later])


def decision_stream(spark, d):
    """The event table as a stream of decisions; its times become UTC instants."""
    s = jobs.file_stream(spark, d, TABLES["events"], "events.parquet")
    return jobs.Feed(
        s.select(
            F.col("event_id").alias("seq"), utc_instant(F.col("ts")).alias("ts"),
            F.col("user_id").alias("entity"), F.col("event_type").alias("stage"),
            t.status_of_stage(F.col("event_type")).alias("status"), F.col("value").alias("cost"),
        )
    )


@query(
    "str1_register_stream",
    """
    SELECT base_id, arg_min(arxiv_id, doc_id) AS arxiv_id, arg_min(field, doc_id) AS field, min(doc_id) AS doc_id
    FROM papers_v GROUP BY base_id
    """,
)
def register_stream(spark, d):
    p = t.papers(spark, d).select("base_id", "arxiv_id", "field", "doc_id")
    table = jobs.register_stream(
        _arriving(spark, p, "doc_id"), "doc_id",
        "base_id STRING, arxiv_id STRING, field STRING, doc_id BIGINT",
    )
    return table.rows().drop("batch")


@query(
    "str2_entity_states",
    f"""SELECT entity, status, cost, failures, steps FROM ({_LOG_SQL.format(cost="round(sum(cost), 4)")})""",
)
def entity_states(spark, d):
    table = jobs.entity_states(decision_stream(spark, d), "entity")
    return table.latest(["entity"]).select(
        "entity", "status", F.round("cost", 4).alias("cost"), "failures", "steps"
    )


@query(
    "str3_live_counters",
    "SELECT stage, status, count(*) AS n FROM decisions_v GROUP BY stage, status",
)
def live_counters(spark, d):
    table = jobs.live_counters(
        decision_stream(spark, d), ["stage", "status"], "stage STRING, status STRING, n BIGINT"
    )
    return table.latest(["stage", "status"]).select("stage", "status", "n")


@query(
    "str4_throughput_windows",
    """
    SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) // 1000000 AS start, count(*) AS n,
           count(*) FILTER (status = 'labeled') AS done
    FROM decisions_v GROUP BY 1
    """,
)
def throughput_windows(spark, d):
    table = jobs.throughput_windows(decision_stream(spark, d), "ts", "6 hours", "30 days")
    return table.latest(["start"]).select(F.unix_timestamp("start").alias("start"), "n", "done")


# The third of the order an id falls into: the arrival it belongs to.
_PART = "CASE WHEN {k} < (top + 1) // 3 THEN 0 WHEN {k} < (top + 1) * 2 // 3 THEN 1 ELSE 2 END"


@query(
    "str5_intake_control",
    f"""
    SELECT done, waiting, CASE WHEN done >= 150 THEN 'stop' WHEN waiting > 300 THEN 'pause' ELSE 'run' END AS action, batch
    FROM (SELECT batch, CAST(sum(d) OVER w AS BIGINT) AS done, CAST(sum(p) OVER w AS BIGINT) AS waiting FROM (
            SELECT {_PART.format(k="seq")} AS batch, count(*) FILTER (status = 'labeled') AS d,
                   count(*) FILTER (status = 'pending') AS p
            FROM decisions_v, (SELECT max(seq) AS top FROM decisions_v) GROUP BY 1) WINDOW w AS (ORDER BY batch))
    """,
)
def intake_control(spark, d):
    log = t.decisions(spark, d).select("seq", "status")
    table = jobs.intake_control(_arriving(spark, log, "seq"), target=150, backlog=300)
    return table.rows()


@query(
    "str6_refreshed_gallery",
    f"""
    WITH {_GALLERY}
    SELECT field AS category, name, CAST(to_json(struct_pack(url := 'v3/img/' || field || '/' || name, category := field,
             arxiv_id := arxiv_id, page := CAST(page AS INT), caption := coalesce(caption, ''))) AS VARCHAR) AS line
    FROM g WHERE status = 'uploaded'
    """,
)
def refreshed_gallery(spark, d):
    g = gallery_images(spark, d).drop("p_diagram")
    schema = ", ".join(f"{n} {ty}" for n, ty in g.dtypes)
    published = jobs.refreshed_snapshot(_arriving(spark, g, "image_id"), schema, "name")
    return stores.gallery_lines(published.rows())


@query("str7_archive_stream", f"SELECT field, image_id, batch AS archive_no FROM ({ARCHIVE_SQL})")
def archive_stream(spark, d):
    i = t.images(spark, d).select("field", "image_id", "file_bytes")
    table = jobs.archive_stream(
        _arriving(spark, i, "image_id"), "field", "image_id", "file_bytes",
        id_bucket(F.col("image_id"), 4096), ARCHIVE_CAP,
        "field STRING, image_id BIGINT, archive_no BIGINT", "field STRING, closed BIGINT, carry DOUBLE",
    )
    return table.rows().drop("batch")


@query(
    "str8_delivery_stream",
    f"""
    WITH m AS (SELECT image_id, row_number() OVER (ORDER BY field, image_id) AS pos FROM images_v),
         a AS (SELECT DISTINCT user_id AS uid, {_PART.format(k="event_id")} AS batch
               FROM events, (SELECT max(event_id) AS top FROM events)),
         r AS (SELECT uid, batch, row_number() OVER (PARTITION BY uid ORDER BY batch) AS nth FROM a)
    SELECT uid, image_id, batch FROM r JOIN m ON m.pos > 200 * (nth - 1) AND m.pos <= 200 * nth
    """,
)
def delivery_stream(spark, d):
    requests = t.table(spark, d, "events").select(F.col("user_id").alias("uid"), "event_id")
    return jobs.delivery_stream(_arriving(spark, requests, "event_id"), positioned_manifest(spark, d)).rows()


@query(
    "str5_governed_intake",
    """
    WITH RECURSIVE q AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_type = 'purchase' AS success FROM events),
      t AS (SELECT count(*) AS n FROM q),
      c AS (SELECT -1 AS cycle, 0 AS admitted, 0 AS done, 0 AS successes, 'run' AS action FROM t
            UNION ALL
            SELECT cycle + 1, a, least(done + n // 16, a), (SELECT count(*) FILTER (success) FROM q WHERE pos < least(done + n // 16, a)), act
            FROM (SELECT *, CASE act WHEN 'run' THEN least(n, admitted + n // 10) ELSE admitted END AS a
                  FROM (SELECT c.* EXCLUDE (action), n, CASE WHEN admitted >= n THEN 'end'
                               WHEN least(n, admitted + n // 10) - done > n // 5 THEN 'pause' ELSE 'run' END AS act
                        FROM c, t WHERE successes < n // 10 AND done < n)))
    SELECT CAST(cycle AS BIGINT) AS cycle, action, CAST(admitted AS BIGINT) AS admitted, CAST(done AS BIGINT) AS done,
           CAST(admitted - done AS BIGINT) AS waiting, CAST(successes AS BIGINT) AS successes
    FROM c WHERE cycle >= 0
    """,
)
def governed_intake(spark, d):
    """Events as the queue: intake takes a tenth of it a turn and stops at a fifth
    waiting, the worker a sixteenth, until a tenth of the queue are purchases."""
    events = t.table(spark, d, "events").select("event_id", "event_type")
    ranked = rank_within(events, [], [F.col("event_id")], [id_bucket(F.col("event_id"))], "rn")
    queue = materialised(ranked.select((F.col("rn") - 1).alias("pos"), "event_id", "event_type"), "intake-queue")
    n = queue.count()

    def work(rows):
        return rows.select("pos", (F.col("event_type") == "purchase").alias("success"))

    return intake.governed_intake(
        queue, shared_path(spark, "intake"), work, "pos LONG, success BOOLEAN",
        target=n // 10, admit=n // 10, capacity=n // 16, backlog=n // 5,
    )

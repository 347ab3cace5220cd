"""Registered queries and, beside each, the SQL text that states its answer."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}

# The derived tables of figureyard.sources.tables, stated as SQL.
VIEWS = {
    "papers_v": """
        SELECT doc_id,
               lpad(CAST(base_no AS VARCHAR), 6, '0') || 'v' || CAST(doc_id % 3 + 1 AS VARCHAR) AS arxiv_id,
               lpad(CAST(base_no AS VARCHAR), 6, '0') AS base_id,
               lang AS field, source, split_part(text, chr(10), 1) AS title,
               CAST(floor(n_chars / 500.0) AS INT) + 1 AS n_pages,
               CASE WHEN doc_id % 10 = 0 THEN 'failed' WHEN doc_id % 10 = 1 THEN 'pending'
                    ELSE 'downloaded' END AS status
        FROM (SELECT *, CASE WHEN doc_id % 5 = 0 AND doc_id > 0 THEN doc_id - 1 ELSE doc_id END AS base_no
              FROM documents)""",
    "pages_v": """
        SELECT arxiv_id, doc_id, field, page_no,
               (doc_id + page_no) % 10 >= 3 AS has_graphics,
               (doc_id * 7 + page_no) % 5 < 2 AS screen_pos,
               (doc_id * 11 + page_no) % 4 <> 0 AS confirm_pos,
               CAST(0.25 AS DOUBLE) AS screen_cost, CAST(1.5 AS DOUBLE) AS confirm_cost
        FROM (SELECT arxiv_id, doc_id, field, CAST(unnest(range(1, n_pages + 1)) AS INT) AS page_no
              FROM papers_v)""",
    "images_v": """
        SELECT image_id, arxiv_id, field, page_no, status,
               CASE WHEN status <> 'rejected' THEN ''
                    WHEN image_id % 5 = 0 THEN 'local:tiny-file' WHEN image_id % 5 = 1 THEN 'llm:data plot'
                    WHEN image_id % 5 = 2 THEN 'llm:photograph' WHEN image_id % 5 = 3 THEN 'llm:heatmap'
                    ELSE 'llm:fragment' END AS reject_reason,
               file_bytes, width, height, toxic
        FROM (SELECT d.doc_id AS image_id, p.arxiv_id, p.field, d.doc_id % p.n_pages + 1 AS page_no,
                     CASE WHEN l.quality = 1 THEN 'labeled' WHEN l.quality = 0 THEN 'rejected'
                          WHEN d.doc_id % 2 = 0 THEN 'rejected' ELSE 'pending' END AS status,
                     d.n_chars AS file_bytes, 40 + d.doc_id % 900 AS width,
                     40 + (d.doc_id * 7) % 700 AS height, l.toxic
              FROM documents d JOIN papers_v p ON p.doc_id = d.doc_id
              LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "preds_v": """
        SELECT vec_id AS image_id, label % 4 AS y4,
               CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 4 ELSE label % 4 END AS pred_a,
               CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 4 ELSE label % 4 END AS pred_b,
               CASE WHEN label % 4 = 0 THEN 50 + (vec_id * 37) % 50 ELSE (vec_id * 37) % 70 END
                 / CAST(100 AS DOUBLE) AS p_diagram,
               'f' || CAST(label AS VARCHAR) AS field
        FROM embeddings""",
    "rects_v": """
        SELECT DISTINCT l_orderkey AS page_key,
               CASE WHEN l_linenumber % 2 = 0 THEN 'image' ELSE 'vector' END AS kind,
               (l_partkey * 37) % 400 AS x0, (l_suppkey * 53) % 560 AS y0,
               (l_partkey * 37) % 400 + CAST(l_quantity AS INT) * 4 + 20 AS x1,
               (l_suppkey * 53) % 560 + (l_partkey * 13) % 200 + 20 AS y1
        FROM lineitem""",
    "blocks_v": """
        SELECT DISTINCT l_orderkey AS page_key, (l_suppkey * 29) % 400 AS bx0, (l_partkey * 17) % 760 AS by0,
               (l_suppkey * 29) % 400 + 150 AS bx1, (l_partkey * 17) % 760 + 12 AS by1,
               CASE WHEN l_linenumber % 3 = 0 THEN 'Figure ' || CAST(l_linenumber AS VARCHAR)
                    ELSE 'text ' || l_returnflag || CAST(l_partkey AS VARCHAR) END AS txt
        FROM lineitem""",
    "boxes_v": """
        SELECT page_key, CASE WHEN kind = 'image' THEN 'figure' ELSE 'table' END AS cls,
               (page_key * 31 + x0 * 17 + y0) % 100 / CAST(100 AS DOUBLE) AS conf, x0, y0, x1, y1,
               CASE WHEN page_key % 3 = 0 THEN 1 ELSE 0 END AS has_diagram, 612 AS w, 792 AS h
        FROM rects_v""",
    "decisions_v": """
        SELECT event_id AS seq, ts, user_id AS entity, event_type AS stage,
               CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'labeled'
                    WHEN event_type = 'signup' THEN 'rejected' ELSE 'pending' END AS status,
               value AS cost
        FROM events""",
    "downloads_v": """
        SELECT DISTINCT user_id AS uid, event_id % 200 AS image_id FROM events WHERE event_type = 'view'""",
    "timings_v": """
        SELECT event_type AS model, CASE WHEN event_id % 2 = 0 THEN 'mps' ELSE 'cpu' END AS device,
               value AS ms
        FROM events""",
    # crops with a silver class, trivial rejects capped at 50 by seeded hash
    "crops_v": """
        SELECT image_id, path, cls, field, arxiv_id, source FROM (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('20260716|' || image_id), image_id) AS pick
          FROM (SELECT image_id, 'images/' || field || '/' || image_id || '.png' AS path,
                       CASE WHEN status = 'labeled' THEN 'diagram'
                            WHEN lower(reject_reason) LIKE 'local:%' THEN 'fragment_junk'
                            WHEN regexp_matches(lower(reject_reason), 'plot|heatmap|chart|graph of|phase map|spectrogram|histogram') THEN 'data_plot'
                            WHEN regexp_matches(lower(reject_reason), 'photo|micrograph') THEN 'photo'
                            ELSE 'fragment_junk' END AS cls,
                       field, arxiv_id,
                       CASE WHEN status = 'labeled' THEN 'accepted'
                            WHEN lower(reject_reason) LIKE 'local:%' THEN 'local' ELSE 'llm' END AS source
                FROM images_v WHERE status IN ('labeled', 'rejected')))
        WHERE source <> 'local' OR pick <= 50""",
    # one split per paper of the crops and of the judged pages
    "splits_v": """
        SELECT arxiv_id, field,
               CASE WHEN pos <= round_even(n * 0.7::DOUBLE, 0) THEN 'train'
                    WHEN pos <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val'
                    ELSE 'test' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY md5('20260716|' || arxiv_id), arxiv_id) AS pos,
                     count(*) OVER (PARTITION BY field) AS n
              FROM (SELECT arxiv_id, coalesce(min(crop_field), min(page_field)) AS field
                    FROM (SELECT arxiv_id, field AS crop_field, NULL AS page_field FROM crops_v
                          UNION ALL SELECT arxiv_id, NULL, field FROM pages_v)
                    GROUP BY arxiv_id))""",
    "verdicts_v": """
        SELECT arxiv_id, doc_id, field, page_no,
               CASE WHEN NOT has_graphics THEN false WHEN NOT screen_pos THEN false ELSE confirm_pos END AS has_diagram,
               CASE WHEN NOT has_graphics THEN 0.0::DOUBLE WHEN NOT screen_pos THEN screen_cost
                    ELSE screen_cost + confirm_cost END AS cost
        FROM pages_v""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the view definitions it uses, in definition order."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(VIEWS[name])
    ctes = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in VIEWS if n in needed)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = with_views(sql)
        return fn

    return add

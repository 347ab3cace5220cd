"""Explicit schemas of the curation tables; nothing is inferred from data."""

CLASSES = ("diagram", "data_plot", "photo", "fragment_junk")
SPLITS = ("train", "val", "test")


# Schemas are kept as DDL text, which every Spark reader accepts directly.
PAPERS = (
    "arxiv_id STRING, base_id STRING, field STRING, title STRING, authors STRING, "
    "published DATE, abs_url STRING, pdf_url STRING, status STRING, n_pages INT, error STRING"
)
PAGES = (
    "arxiv_id STRING, page_no INT, status STRING, has_diagram BOOLEAN, detect_json STRING, "
    "ocr_md STRING, batch_id BIGINT, cost DOUBLE, error STRING"
)
IMAGES = (
    "image_id BIGINT, arxiv_id STRING, page_no INT, batch_id BIGINT, file_path STRING, "
    "status STRING, reject_reason STRING, diagram_type STRING, title STRING, label STRING, "
    "cost DOUBLE, error STRING"
)
CROPS_MANIFEST = (
    "image_id BIGINT, path STRING, cls STRING, field STRING, arxiv_id STRING, "
    "source STRING, split STRING"
)
PAGES_MANIFEST = (
    "arxiv_id STRING, page_no INT, has_diagram INT, field STRING, pdf_path STRING, split STRING"
)
GOLD_CROPS = "image_id BIGINT, gold_cls STRING, source STRING, uncertain INT, note STRING"
GOLD_PAGES = "arxiv_id STRING, page_no INT, has_diagram INT, source STRING, uncertain INT"
SPLIT_MAP = "seed BIGINT, rubric_version STRING, fracs MAP<STRING,DOUBLE>, papers MAP<STRING,STRING>"
PREDICTIONS = "image_id BIGINT, pred4 INT, prob4 ARRAY<DOUBLE>, name STRING, split STRING"
RESULTS = (
    "name STRING, kind STRING, config MAP<STRING,STRING>, "
    "val STRUCT<acc DOUBLE, f1 DOUBLE, precision DOUBLE, recall DOUBLE>, "
    "manifest_sha STRING, timestamp TIMESTAMP, notes STRING"
)
BOXES = (
    "MAP<STRING, STRUCT<split STRING, has_diagram INT, field STRING, "
    "boxes ARRAY<STRUCT<cls STRING, conf DOUBLE, xyxy ARRAY<DOUBLE>>>, img_wh ARRAY<INT>>>"
)
DETECT_REPLY = (
    "has_diagram BOOLEAN, diagrams ARRAY<STRUCT<type STRING, description STRING>>, "
    "page_summary STRING"
)
LABEL_REPLY = (
    "is_diagram BOOLEAN, reject_reason STRING, diagram_type STRING, title STRING, label STRING"
)
OCR_RESPONSE = (
    "pages ARRAY<STRUCT<index INT, markdown STRING, "
    "images ARRAY<STRUCT<id STRING, image_base64 STRING>>>>"
)
GALLERY = (
    "base STRING, display MAP<STRING,STRING>, start DOUBLE, target BIGINT, count BIGINT, "
    "updated_epoch DOUBLE, images ARRAY<STRUCT<url STRING, category STRING, arxiv_id STRING, "
    "page INT, caption STRING>>"
)
GALLERY_LINE = "url STRING, category STRING, arxiv_id STRING, page INT, caption STRING"
FEED_ENTRY = (
    "id STRING, title STRING, summary STRING, published STRING, "
    "author ARRAY<STRUCT<name STRING>>, link ARRAY<STRUCT<_title STRING, _href STRING>>"
)

# The plain tables of a data folder.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
        "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

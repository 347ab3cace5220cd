"""Rows extracted from whole documents by a plugged-in function."""

import re

from pyspark.sql import functions as F

from figureyard.operators.extract import extract_rows
from figureyard.plans.catalog import query
from figureyard.sources import tables as t


def figure_mentions(doc):
    """Every numbered word of a text; texts without any letter are refused."""
    if not re.search("[A-Za-z]", doc["text"]):
        raise ValueError("no text layer")
    for i, m in enumerate(re.finditer(r"([A-Za-z]+) ([0-9]+)", doc["text"]), start=1):
        yield {"ordinal": i, "word": m.group(1), "number": m.group(2)}


@query(
    "udf2_extracted_rows",
    """
    SELECT doc_id, count(*) AS n, md5(string_agg(w, '|' ORDER BY i)) AS digest FROM (
      SELECT doc_id, unnest(m) AS w, generate_subscripts(m, 1) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+ [0-9]+') AS m FROM documents
        WHERE regexp_matches(text, '[A-Za-z]')))
    GROUP BY doc_id
    """,
)
def extracted_rows(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", "text")
    rows, _ = extract_rows(docs, "doc_id", figure_mentions, "ordinal int, word string, number string")
    # the rows of one document, which fit the task that extracted them
    words = F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "word", "number"))),
        lambda r: F.concat_ws(" ", r["word"], r["number"]),
    )
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.md5(F.array_join(words, "|")).alias("digest")
    )


@query(
    "udf2_extraction_errors",
    """
    SELECT doc_id, 'ValueError: no text layer' AS error FROM documents
    WHERE NOT regexp_matches(text, '[A-Za-z]')
    """,
)
def extraction_errors(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", "text")
    return extract_rows(docs, "doc_id", figure_mentions, "ordinal int, word string, number string")[1]

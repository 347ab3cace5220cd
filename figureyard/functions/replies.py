"""Bulk parsing of free-text model replies and rendering of request texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figureyard.functions.columns import strip

_LENIENT = {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": "_corrupt_record"}

# Defaults of missing reply keys and of empty request parts.
DETECT_DEFAULTS = {"has_diagram": False, "page_summary": ""}
LABEL_DEFAULTS = {
    "is_diagram": False, "reject_reason": "", "diagram_type": "", "title": "", "label": "",
}
NO_TEXT, NO_CONTEXT = "(no OCR text available)", "(none)"


def json_candidate(reply: Column) -> Column:
    """Inside of the first code fence if there is one, cut to the first brace,
    with ``\\b \\f \\r`` doubled where a letter follows."""
    trimmed = strip(reply)
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    inner = F.when(trimmed.rlike(fence), strip(F.regexp_extract(trimmed, fence, 1))).otherwise(
        trimmed
    )
    start = F.instr(inner, "{")
    cut = F.when(start > 0, F.substr(inner, start))
    return F.regexp_replace(cut, r"\\([bfr])(?=[a-zA-Z])", r"\\\\$1")


def parse_replies(
    df: DataFrame, reply: str, schema: str, defaults: dict[str, object]
) -> DataFrame:
    """Add ``parsed`` (struct) and ``parse_error`` (text or null).

    A reply that fails once is retried with every backslash doubled that does
    not begin a valid escape. Missing keys take their default.
    """
    full = schema + ", _corrupt_record STRING"
    text = F.col("__candidate")
    repaired = F.regexp_replace(text, r'\\(?![\\/"bfnrtu])', r"\\\\")
    step = (
        df.withColumn("__candidate", json_candidate(F.col(reply)))
        .withColumn("__first", F.from_json(text, full, _LENIENT))
        .withColumn("__second", F.from_json(repaired, full, _LENIENT))
    )
    first, second = F.col("__first"), F.col("__second")
    good = F.when(
        text.isNotNull() & first["_corrupt_record"].isNull(), first
    ).when(text.isNotNull() & second["_corrupt_record"].isNull(), second)
    out = step.withColumn("__good", good)
    names = [part.strip().split(" ")[0] for part in _top_level(schema)]
    fields = [
        F.coalesce(F.col("__good")[n], F.lit(defaults[n])).alias(n) if n in defaults
        else F.col("__good")[n].alias(n)
        for n in names
    ]
    error = F.when(text.isNull(), "no JSON object").when(
        F.col("__good").isNull(), "invalid JSON"
    )
    return out.withColumns(
        {
            "parsed": F.when(F.col("__good").isNotNull(), F.struct(*fields)),
            "parse_error": error,
        }
    ).drop("__candidate", "__first", "__second", "__good")


def _top_level(schema: str) -> list[str]:
    depth, start, parts = 0, 0, []
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(schema[start:i])
            start = i + 1
    return [*parts, schema[start:]]


def context_lines(diagrams: Column, summary: Column) -> Column:
    """``- type: description`` per diagram, then the page summary if any."""
    lines = F.array_join(
        F.transform(
            F.coalesce(diagrams, F.array().cast("array<struct<type:string,description:string>>")),
            lambda d: F.concat(
                F.lit("- "), F.coalesce(d["type"], F.lit("diagram")), F.lit(": "),
                F.coalesce(d["description"], F.lit("")),
            ),
        ),
        "\n",
    )
    tail = F.when(
        F.length(F.coalesce(summary, F.lit(""))) > 0,
        F.concat(F.lit("\nPage summary: "), summary),
    ).otherwise("")
    return F.concat(lines, tail)


def request_text(page: Column, title: Column, field: Column, ocr: Column, context: Column) -> Column:
    """Text of a labelling request; empty parts are named as such."""
    def or_else(c: Column, fallback: str) -> Column:
        trimmed = strip(F.coalesce(c, F.lit("")))
        return F.when(F.length(trimmed) > 0, trimmed).otherwise(fallback)

    return F.format_string(
        "Page %d of \"%s\" (%s)\nText:\n%s\nFigures:\n%s",
        page, title, field, or_else(ocr, NO_TEXT), or_else(context, NO_CONTEXT),
    )

"""Column expressions shared by the curation jobs. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from figureyard.schemas import CLASSES

# Length limits of stored text.
ERROR_CHARS, REASON_CHARS, OCR_CHARS, CAPTION_CHARS, PREFIX_CHARS = 500, 200, 4000, 800, 40

# Display name of each field.
FIELD_NAMES = {
    "semiconductor_engineering": "Semiconductor Engineering",
    "manufacturing_engineering": "Manufacturing Engineering",
    "robotics_automation": "Robotics & Automation",
    "utilities_power_systems": "Utilities & Power Systems",
    "aerospace_engineering": "Aerospace Engineering",
    "telecommunications": "Telecommunications",
}

# HTTP status codes of a failed call.
FATAL_CODES, RETRY_CODES = (402,), (429, 500, 502, 503, 504)

# Accepted image suffixes and the one used for any other.
IMAGE_SUFFIXES, DEFAULT_SUFFIX = ("png", "jpg", "jpeg", "webp"), "jpeg"


def base_id(arxiv_id: Column) -> Column:
    """Id without its version. Only a trailing ``v<digits>`` is a version."""
    return F.regexp_replace(arxiv_id, "v[0-9]+$", "")


def safe_name(arxiv_id: Column) -> Column:
    return F.replace(arxiv_id, F.lit("/"), F.lit("_"))


def page_name(arxiv_id: Column, page_no: Column) -> Column:
    return F.format_string("%s_p%03d", safe_name(arxiv_id), page_no)


def crop_name(arxiv_id: Column, page_no: Column, ordinal: Column) -> Column:
    return F.format_string("%s_p%03d_%02d", safe_name(arxiv_id), page_no, ordinal)


def batch_name(number: Column, digits: int = 5) -> Column:
    return F.format_string(f"batch_%0{digits}d", number)


def strip(text: Column) -> Column:
    """Without white space at both ends, also tabs and line breaks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column, chars: int | None = None) -> Column:
    """Whitespace runs become one blank, ends are trimmed, then cut."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.substring(out, 1, chars) if chars else out


def scrub(text: Column) -> Column:
    """Drop control characters but keep tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def joined(names: Column) -> Column:
    return F.array_join(names, "; ")


def suffix_of(name: Column) -> Column:
    """Lower-cased file suffix from the accepted list, or the default one."""
    found = F.lower(F.element_at(F.split(name, r"\."), -1))
    known = name.contains(".") & found.isin(*IMAGE_SUFFIXES)
    return F.when(known, found).otherwise(DEFAULT_SUFFIX)


def media_type(name: Column) -> Column:
    suffix = suffix_of(name)
    return F.concat(F.lit("image/"), F.when(suffix == "jpg", "jpeg").otherwise(suffix))


def data_uri(media: Column, payload: Column) -> Column:
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.base64(payload))


def data_uri_bytes(uri: Column) -> Column:
    return F.unbase64(F.regexp_replace(uri, "^data:[^,]*,", ""))


def rect_json(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    sides = [F.bround(c.cast("double"), 0).cast("int") for c in (x0, y0, x1, y1)]
    return F.to_json(F.array(*sides))


def rect_from_json(text: Column) -> Column:
    return F.from_json(text, "array<int>")


def aspect(w: Column, h: Column) -> Column:
    return F.greatest(w, h) / F.greatest(F.lit(1), F.least(w, h))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a rectangle, zero if it is empty or turned inside out."""
    zero = F.lit(0)
    return F.greatest(x1 - x0, zero) * F.greatest(y1 - y0, zero)


def intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return area(
        F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]),
        F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]),
    )


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over the smaller area; an empty second area counts as 1."""
    area_a = area(a["x0"], a["y0"], a["x1"], a["y1"])
    area_b = area(b["x0"], b["y0"], b["x1"], b["y1"])
    area_b = F.when(area_b == 0, 1).otherwise(area_b)
    inter = intersection(a, b)
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / F.least(area_a, area_b))


def class_index(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CLASSES]), name).cast("int") - 1


def class_name(index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CLASSES]), index)


def display_name(field: Column, names: dict[str, str] = FIELD_NAMES) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, field), field)


def digest16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def rounded(value: Column, digits: int = 4) -> Column:
    """Half-even rounding."""
    return F.bround(value, digits)


def ratio(part: Column, whole: Column) -> Column:
    """Quotient that is zero when the divisor is zero."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def failure_class(code: Column) -> Column:
    return (
        F.when(code.isin(*FATAL_CODES), "fatal")
        .when(code.isin(*RETRY_CODES), "retry")
        .when(code.isNull() | (code < 400), "ok")
        .otherwise("final")
    )


def is_caption(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*fig(?:ure)?\.?\s*\d+")


def looks_like_caption(text: Column) -> Column:
    """Caption of a figure, table or scheme, as used to anchor a figure."""
    return text.rlike(r"(?i)^(fig(ure)?|table|scheme)\b")


def object_key(url: Column) -> Column:
    """Viewer path of a crop to its object key."""
    return F.regexp_replace(url, "^img/", "v3/img/")


def archive_entry(field: Column, key: Column) -> Column:
    return F.concat_ws("/", field, F.substring_index(key, "/", -1))


def hash_int(text: Column) -> Column:
    """First 32 bits of md5 as a non-negative number, equal on every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def utc_instant(ts: Column) -> Column:
    """A time without zone, read as UTC whatever the zone of the session is."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def utc_day(instant: Column) -> Column:
    local = instant.cast("timestamp_ntz")
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), local))

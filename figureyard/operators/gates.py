"""Accept / reject decisions and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figureyard.functions.columns import aspect, strip
from figureyard.operators.ranking import id_bucket, rank_within

# Thresholds of the crop gate.
MIN_BYTES, MIN_SIDE, MAX_ASPECT, MIN_STD, MIN_CONTENT = 8192, 80, 8, 8.0, 0.02

# Words of a reject reason that name a class.
PLOT_WORDS = ("plot", "heatmap", "chart", "graph of", "phase map", "spectrogram", "histogram")
PHOTO_WORDS = ("photo", "micrograph")


def page_verdict(
    pages: DataFrame, screens: DataFrame, confirms: DataFrame, keys: list[str]
) -> DataFrame:
    """Screen, then confirm. A page without graphics is negative at no cost, a
    negative screen is final, and costs of both judges add up."""
    zero = F.lit(0.0)
    joined = pages.join(screens, keys, "left").join(confirms, keys, "left")
    graphics = F.col("has_graphics")
    screened = graphics & F.coalesce("screen_pos", F.lit(False))
    return joined.withColumns(
        {
            "has_diagram": F.when(~graphics, False)
            .when(~screened, False)
            .otherwise(F.coalesce("confirm_pos", F.lit(False))),
            "cost": F.when(graphics, F.coalesce("screen_cost", zero)).otherwise(zero)
            + F.when(screened, F.coalesce("confirm_cost", zero)).otherwise(zero),
        }
    )


def crop_decision(is_diagram: Column, label: Column, reason: Column) -> dict[str, Column]:
    """Accepted with a non-blank label; otherwise the reason, or a default one."""
    accepted = F.coalesce(is_diagram, F.lit(False)) & (
        F.length(strip(F.coalesce(label, F.lit("")))) > 0
    )
    text = strip(F.coalesce(reason, F.lit("")))
    text = F.when(F.length(text) > 0, text).otherwise("not-a-diagram")
    return {
        "status": F.when(accepted, "labeled").otherwise("rejected"),
        "reject_reason": F.when(accepted, "").otherwise(F.concat(F.lit("llm:"), text)),
    }


def gate_accept(
    candidates: DataFrame, threshold: float, doc: str, order: list[Column], bucket: list[Column]
) -> DataFrame:
    """Candidates the local classifier accepts, numbered per document."""
    kept = candidates.filter((F.col("cls") == "diagram") & (F.col("p") >= threshold))
    return rank_within(kept, [doc], order, bucket, name="ordinal")


def fallback_assets(pages: DataFrame, crops: DataFrame, keys: list[str], asset: str) -> DataFrame:
    """Crops of a page, or the page itself when it has none."""
    return pages.join(crops, keys, "left").withColumn(
        "item", F.coalesce(F.col(asset), F.concat(F.lit("page:"), F.col("page_asset")))
    )


def crop_reject_reason(
    size: Column, readable: Column, width: Column, height: Column,
    std: Column | None = None, content: Column | None = None,
) -> Column:
    """First rule that fails, empty when the crop passes. A missing file passes."""
    rule = (
        F.when(size.isNull(), "")
        .when(size < MIN_BYTES, "tiny-file")
        .when(~readable, "unreadable")
        .when((width < MIN_SIDE) | (height < MIN_SIDE), "tiny-dims")
        .when(aspect(width, height) > MAX_ASPECT, "extreme-aspect")
    )
    if std is not None:
        rule = rule.when(std < MIN_STD, "near-blank")
    if content is not None:
        rule = rule.when(content < MIN_CONTENT, "low-content")
    return rule.otherwise("")


def silver_class(status: Column, reason: Column) -> Column:
    """Class of a decided crop and where the decision came from."""
    text = F.lower(F.coalesce(reason, F.lit("")))
    body = F.regexp_replace(text, "^llm:", "")

    def made(cls: str, source: str) -> Column:
        return F.struct(F.lit(cls).alias("cls"), F.lit(source).alias("source"))

    return (
        F.when(status == "labeled", made("diagram", "accepted"))
        .when(text.startswith("local:"), made("fragment_junk", "local"))
        .when(body.rlike("|".join(PLOT_WORDS)), made("data_plot", "llm"))
        .when(body.rlike("|".join(PHOTO_WORDS)), made("photo", "llm"))
        .otherwise(made("fragment_junk", "llm"))
    )


def box_gate(boxes: Column, wh: Column, conf: float, frac: float) -> Column:
    """1 when a figure box is confident and large enough."""
    need = F.lit(frac) * F.get(wh, 0) * F.get(wh, 1)
    return F.exists(
        boxes,
        lambda b: (b["cls"] == "figure")
        & (b["conf"] >= conf)
        & ((b["xyxy"][2] - b["xyxy"][0]) * (b["xyxy"][3] - b["xyxy"][1]) >= need),
    ).cast("int")


def pages_without_graphics(pages: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    return pages.join(rects.select(*keys).distinct(), keys, "left_anti")


def facet_page(items: DataFrame, facet: str, key: str, page: int, size: int = 60) -> DataFrame:
    """One page of every facet in key order."""
    ranked = rank_within(items, [facet], [F.col(key)], [id_bucket(F.col(key))], name="pos")
    first = (page - 1) * size
    return ranked.filter((F.col("pos") > first) & (F.col("pos") <= first + size))

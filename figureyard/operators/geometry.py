"""Figure regions of a page: filters, merging, suppression and captions.

Pages with few rectangles are worked on whole, many to a batch. A crowded page is
cut into pieces by density (``planar``) or compared through tiles of it, so no task
sees a whole page that holds most of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figureyard.functions.columns import (
    CAPTION_CHARS, area, aspect, looks_like_caption, overlap, squeeze, strip,
)
from figureyard.operators import planar
from figureyard.operators.planar import SIDES
from figureyard.operators.ranking import top_per_group
from figureyard.session import materialised

# Limits of a figure region, in points or as a share of the page.
MIN_FRAC, MAX_FRAC, MIN_SIDE, MAX_ASPECT, MIN_STROKE = 0.03, 0.92, 55, 6.0, 3
GAP, MAX_OVERLAP, BAND_ABOVE, BAND_BELOW = 14, 0.6, 3, 260

TILE = 128


def _rect(prefix: str = "") -> dict[str, Column]:
    return {s: F.col(f"{prefix}{s}") for s in SIDES}


def clip(df: DataFrame, w: Column, h: Column) -> DataFrame:
    zero = F.lit(0)
    return df.withColumns(
        {
            "x0": F.greatest("x0", zero), "y0": F.greatest("y0", zero),
            "x1": F.least(F.col("x1"), w), "y1": F.least(F.col("y1"), h),
        }
    )


def figure_candidates(rects: DataFrame, w: Column, h: Column) -> DataFrame:
    """Rectangles that are large, tall and compact enough to be a figure."""
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    drawn = (F.col("kind") != "vector") | ((wide > MIN_STROKE) & (high > MIN_STROKE))
    clipped = clip(rects.filter(drawn), w, h)
    share = area(**_rect()) / (w * h)
    return clipped.withColumn("area_frac", share).filter(
        (F.col("area_frac") >= MIN_FRAC)
        & (F.col("area_frac") <= MAX_FRAC)
        & (wide > MIN_SIDE)
        & (high > MIN_SIDE)
        & (aspect(wide, high) <= MAX_ASPECT)
    )


def _level(r: dict[str, Column]) -> Column:
    """Size class: at this level a rectangle's longer side spans at most one cell
    more than one, so it lies in few cells however large it is."""
    side = F.greatest(r["x1"] - r["x0"], r["y1"] - r["y0"], F.lit(1))
    return F.greatest(F.lit(0), F.ceil(F.log2(side / TILE))).cast("int")


def _levels(*frames: DataFrame) -> list[int]:
    """The size classes in use, at most one for each power of two."""
    found: set[int] = set()
    for df in frames:
        found |= {r["lv"] for r in df.select(_level(_rect()).alias("lv")).distinct().collect()}
    return sorted(x for x in found if x is not None)


def _cells(df: DataFrame, levels: Column, gap: float = 0, prefix: str = "") -> DataFrame:
    """A row for each cell (lv, cx, cy) that a rectangle, widened by ``gap``,
    touches at each of ``levels``."""
    r = _rect(prefix)
    cell = F.lit(TILE) * F.pow(F.lit(2.0), F.col("lv"))

    def steps(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor((lo - gap) / cell), F.floor((hi + gap) / cell))

    return (
        df.withColumn("lv", F.explode(levels))
        .withColumn("cx", F.explode(steps(r["x0"], r["x1"])))
        .withColumn("cy", F.explode(steps(r["y0"], r["y1"])))
    )


def _own_and_coarser(levels: list[int]) -> tuple[Column, Column]:
    """Levels of a rectangle: its own, and all in use from there up."""
    own = _level(_rect())
    return F.array(own), F.filter(F.array(*map(F.lit, levels)), lambda x: x >= own)


CELL = ("lv", "cx", "cy")


def _centre_cells(df: DataFrame, levels: list[int]) -> DataFrame:
    """A row for the cell of a rectangle's centre at each level in use from the one
    below its own up."""
    own = _level(_rect()) - 1
    cell = F.lit(TILE) * F.pow(F.lit(2.0), F.col("lv"))
    at = {f"c{a}": F.floor((F.col(f"{a}0") + F.col(f"{a}1")) / (2 * cell)) for a in "xy"}
    up = F.filter(F.array(*map(F.lit, levels)), lambda x: x >= own)
    return df.withColumn("lv", F.explode(up)).withColumns(at)


def covered_by(
    rects: DataFrame, others: DataFrame, page: str, limit: float = MAX_OVERLAP, strict: bool = True
) -> DataFrame:
    """Distinct ``rects`` that overlap one of ``others`` on their page by more
    than ``limit``, at least half. Then the larger of two rectangles holds the
    centre of the smaller one and has sides over half as long, so the centre meets
    the few cells that the larger one takes at its size class; nothing is missed."""
    assert limit >= 0.5, "smaller overlaps need not hold a centre"
    left = rects.select(page, *SIDES).distinct()
    right = others.select(page, *SIDES).distinct()
    levels = _levels(left, right)
    if not levels:
        return left

    def found(small: DataFrame, large: DataFrame, swapped: bool) -> DataFrame:
        a, b = _centre_cells(small, levels), _cells(large, F.array(_level(_rect())))
        if swapped:
            a, b = b, a
        b = b.select(*[F.col(c).alias(f"o_{c}") for c in (page, *SIDES, *CELL)])
        wide = [{s: c.cast("double") for s, c in _rect(p).items()} for p in ("", "o_")]
        share = overlap(*wide)
        near = share > limit if strict else share >= limit
        for c in (page, *CELL):
            near = (F.col(c) == F.col(f"o_{c}")) & near
        # a semi join stops at the first match, pairs are never emitted
        return a.join(b, near, "left_semi").select(page, *SIDES)

    return found(left, right, False).union(found(right, left, True)).distinct()


def not_covered(rects: DataFrame, others: DataFrame, page: str, limit: float = MAX_OVERLAP,
                strict: bool = True) -> DataFrame:
    """Rectangles left after removing those covered by ``others``."""
    return rects.join(
        covered_by(rects, others, page, limit, strict), [page, *SIDES], "left_anti"
    )


def _greedy(ranked: Column) -> Column:
    """Kept rectangles of a page in priority order, as a Catalyst fold."""
    empty = F.filter(ranked, lambda _: F.lit(False))
    side = lambda s: {k: s[k] for k in SIDES}
    return F.aggregate(
        ranked, empty,
        lambda kept, c: F.when(
            F.forall(kept, lambda k: overlap(side(c), side(k)) < MAX_OVERLAP),
            F.concat(kept, F.array(c)),
        ).otherwise(kept),
    )


def _best_of_pages(rows: pa.Table, starts: np.ndarray) -> pa.Table:
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, rows.num_rows]))
    boxes, size = planar.sides_of(rows), rows.column("area_frac").to_numpy()
    order = np.lexsort((*boxes.T[::-1], -size, group))
    return rows.take(order[planar.kept_greedily(boxes[order], group[order], MAX_OVERLAP)])


def suppress(
    candidates: DataFrame, page: str, per_round: int = 256, piece: int = planar.PIECE
) -> DataFrame:
    """Greedy suppression per page: by area descending, a rectangle stays if it
    overlaps every kept one by less than the limit. Rows without a page or a side
    leave.

    Pages of up to ``piece`` candidates are decided whole. On a crowded page each
    round decides the best ``per_round`` open rectangles by a fold; all others that
    overlap a kept one leave, and the rest goes to the next round. A round keeps at
    least the best open rectangle, so the result is exact.
    """
    wanted = materialised(
        candidates.dropna(subset=[page, *SIDES]).groupBy(page, *SIDES).agg(
            F.min("kind").alias("kind"), F.max("area_frac").cast("double").alias("area_frac")
        ),
        "suppress-wanted",
    )
    columns = [page, "kind", *SIDES, "area_frac"]
    crowded = planar.crowded_pages(wanted, page, piece)
    if crowded.isEmpty():
        return planar.by_whole_groups(wanted, [page], _best_of_pages, wanted.schema).select(*columns)
    plain = wanted.join(crowded, page, "left_anti")
    kept = planar.by_whole_groups(plain, [page], _best_of_pages, wanted.schema).select(*columns)
    return kept.unionByName(_in_rounds(wanted.join(crowded, page, "left_semi"), page, per_round))


def _in_rounds(open_rects: DataFrame, page: str, per_round: int) -> DataFrame:
    first = F.struct((-F.col("area_frac")).alias("neg"), *SIDES, "kind", "area_frac")
    order = [F.col("area_frac").desc(), *[F.col(s) for s in SIDES]]
    open_rects = materialised(open_rects, "suppress-open")
    rounds = []
    while not open_rects.isEmpty():
        head = top_per_group(open_rects, [page], order, per_round).drop("rn")
        lists = head.groupBy(page).agg(F.array_sort(F.collect_list(first)).alias("open"))
        winners = lists.select(page, F.inline(_greedy(F.col("open")))).select(
            page, "kind", *SIDES, "area_frac"
        )
        rounds.append(materialised(winners, "suppress-kept"))
        # every decided rectangle is a winner or overlaps one
        open_rects = materialised(
            not_covered(open_rects, rounds[-1], page, MAX_OVERLAP, strict=False), "suppress-open"
        )
    kept = rounds[0]
    for winners in rounds[1:]:
        kept = kept.unionByName(winners)
    return kept


def _hulls(boxes: DataFrame, page: str, gap: float, levels: list[int]) -> DataFrame:
    """Every box grown to the hull of the boxes that it comes nearer than ``gap``
    to, equal ones once; ``grew`` tells whether any of them grew."""
    own, up = _own_and_coarser(levels)
    a = _cells(boxes, up, gap)
    b = _cells(boxes, own, gap).select(*[F.col(c).alias(f"o_{c}") for c in (page, *SIDES, *CELL)])
    meet = (
        (F.col("x0") - gap < F.col("o_x1")) & (F.col("x1") + gap > F.col("o_x0"))
        & (F.col("y0") - gap < F.col("o_y1")) & (F.col("y1") + gap > F.col("o_y0"))
    )
    for c in (page, *CELL):
        meet = (F.col(c) == F.col(f"o_{c}")) & meet
    one, other = F.struct(*SIDES), F.struct(*[F.col(f"o_{s}").alias(s) for s in SIDES])
    # both of a pair learn of each other; pairs go straight into map-side minima
    both = F.array(
        F.struct(one.alias("me"), other.alias("it")), F.struct(other.alias("me"), one.alias("it"))
    )
    hull = (
        a.join(b, meet).select(page, F.inline(both)).groupBy(page, "me")
        .agg(F.min("it.x0").alias("x0"), F.min("it.y0").alias("y0"),
             F.max("it.x1").alias("x1"), F.max("it.y1").alias("y1"))
    )
    grew = F.struct(*SIDES) != F.col("me")
    return hull.groupBy(page, *SIDES).agg(F.max(grew).alias("grew"))


def _merged_pieces(boxes: DataFrame, page: str, gap: float, piece: int) -> DataFrame:
    """Boxes merged inside each piece of a page: page, sides and ``alone``."""

    def work(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, rows.num_rows]))
        found, of = planar.merged(planar.sides_of(rows), group, gap)
        head = rows.select([page, "alone"]).take(starts[of])
        for i, s in enumerate(SIDES):
            head = head.append_column(s, pa.array(found[:, i]))
        return head

    kind = boxes.schema[page].dataType.simpleString()
    schema = f"`{page}` {kind}, alone boolean, {', '.join(f'{s} double' for s in SIDES)}"
    return planar.by_whole_groups(planar.in_pieces(boxes, page, piece), [page, "piece"], work, schema)


def merge_rects(
    rects: DataFrame, page: str, gap: float = GAP, piece: int = planar.PIECE
) -> DataFrame:
    """Merged vector clusters per page: boxes grow to the hull of what they come
    near until none does. Boxes without a page or a side leave.

    The end of merging is the same whatever is merged first. So each piece of a
    page is merged by itself; a page of one piece is then done, and a crowded one,
    with fewer boxes, is cut anew as long as that still merges a tenth of them.
    What is left of crowded pages lies apart inside its pieces, so a tile holds few
    boxes, and is compared tile by tile until no box of the page grows.
    """
    as_double = [F.col(s).cast("double").alias(s) for s in SIDES]
    columns = [page, *SIDES]
    boxes = rects.select(page, *as_double).dropna().distinct()
    boxes, left, done = materialised(boxes, "merge-rects"), None, []
    while True:
        found = materialised(_merged_pieces(boxes, page, gap, piece), "merge-pieces")
        done.append(found.filter("alone").select(*columns))
        boxes = found.filter(~F.col("alone")).select(*columns)
        before, left = left, boxes.count()
        if not left or (before is not None and left > 0.9 * before):
            break
    while levels := _levels(boxes):
        grown = materialised(_hulls(boxes, page, gap, levels), "merge-rects")
        moving = grown.filter("grew").select(page).distinct()
        done.append(grown.join(moving, page, "left_anti").select(*columns))
        boxes = materialised(grown.join(moving, page, "left_semi").select(*columns), "merge-moving")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def captions(figures: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """Caption text of every figure from the blocks below it.

    Blocks start within the band under the figure and overlap it sideways. The
    first one that reads like a caption is taken with the block after it,
    otherwise the nearest block. A band is as high as the reach of a figure, so a
    figure belongs to one band and a block is seen by two. Figures and blocks meet
    on page and band, and what is found stays with its figure there: figures are
    shuffled once, blocks once for both passes, and pairs go straight into minima.
    A repeated caption is followed by its own copy.
    """
    span = BAND_BELOW + BAND_ABOVE
    at = F.floor(F.col("by0") / span)
    text = (
        blocks.select(F.col(page).alias("b_page"), "bx0", "bx1", "by0", strip(F.col("txt")).alias("txt"))
        .filter(F.length("txt") > 0)
        .withColumn("b_band", F.explode(F.array(at - 1, at)))
    )
    keys = [page, *SIDES]
    under = (
        (F.col(page) == F.col("b_page")) & (F.col("band") == F.col("b_band"))
        & (F.col("by0") >= F.col("y1") - BAND_ABOVE)
        & (F.col("by0") <= F.col("y1") + BAND_BELOW)
        & (F.col("bx1") >= F.col("x0"))
        & (F.col("bx0") <= F.col("x1"))
    )
    # no block, no spot
    spot = F.when(F.col("by0").isNotNull(), F.struct("by0", "txt"))
    base = figures.select(*keys).distinct().withColumn("band", F.floor((F.col("y1") - BAND_ABOVE) / span))
    firsts = (
        base.join(text, under, "left").groupBy("band", *keys)
        .agg(
            F.min(spot).alias("near"),
            F.min(F.when(looks_like_caption(F.col("txt")), spot)).alias("cap"),
        )
    )
    found = (
        firsts.join(text, under & (F.struct("by0", "txt") >= F.col("cap")), "left")
        .groupBy("band", *keys, "near", "cap")
        .agg(
            F.count_if(spot == F.col("cap")).alias("same"),
            F.min(F.when(spot > F.col("cap"), spot)).alias("later"),
        )
    )
    next_txt = F.when(F.col("same") > 1, F.col("cap.txt")).otherwise(F.col("later.txt"))
    text_of = F.when(
        F.col("cap").isNotNull(), F.concat_ws(" ", F.col("cap.txt"), next_txt)
    ).otherwise(F.col("near.txt"))
    return found.select(
        *keys, F.coalesce(squeeze(text_of, CAPTION_CHARS), F.lit("")).alias("caption")
    )


def extract_figures(
    rects: DataFrame, blocks: DataFrame, page: str, w: Column, h: Column
) -> DataFrame:
    """Figures of every page with their captions: page, kind, sides, area_frac,
    caption.

    Image rectangles and merged vector clusters are clipped and gated, clusters
    covered by a gated image leave, the rest is suppressed greedily, and what is
    kept looks for its caption.
    """
    drawn = (F.col("x1") - F.col("x0") > MIN_STROKE) & (F.col("y1") - F.col("y0") > MIN_STROKE)
    columns = [page, "kind", *[F.col(s).cast("double").alias(s) for s in SIDES]]
    images = figure_candidates(rects.filter(F.col("kind") == "image").select(*columns), w, h)
    clusters = merge_rects(rects.filter((F.col("kind") == "vector") & drawn), page)
    vectors = figure_candidates(clusters.withColumn("kind", F.lit("vector")).select(*columns), w, h)
    images, vectors = materialised(images, "images"), materialised(vectors, "clusters")
    kept = suppress(images.unionByName(not_covered(vectors, images, page)), page)
    return kept.join(captions(kept, blocks, page), [page, *SIDES])

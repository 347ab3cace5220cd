"""Rectangles in pieces of bounded size, worked on by whole pieces in numpy.

A page with few rectangles is one piece. A page with more is cut by a quadtree
over the centres of its rectangles: the coarsest cells that hold at most ``PIECE``
of them are its pieces, and a finest cell that still holds more is dealt by hash.
So a piece is bounded however many rectangles lie on a page or on one spot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figureyard.session import materialised

SIDES = ("x0", "y0", "x1", "y1")
PIECE = 512
FINEST, LEVELS = 16, 24  # side of the smallest cell; how often it may double
PAIRS = 1_000_000  # pairs of rectangles held at once


def crowded_pages(boxes: DataFrame, page: str, size: int = PIECE) -> DataFrame:
    """Pages with more than ``size`` rows, as a written table."""
    counts = boxes.groupBy(page).agg(F.count(F.lit(1)).alias("n"))
    return materialised(counts.filter(F.col("n") > size).select(page), "crowded-pages")


def _quadtree(boxes: DataFrame, page: str, size: int) -> DataFrame:
    centre = {
        f"f{a}": F.floor((F.col(f"{a}0") + F.col(f"{a}1")) / (2 * FINEST)).cast("bigint") for a in "xy"
    }
    boxes = boxes.withColumns(centre)
    fine = [page, "fx", "fy"]
    cells = materialised(boxes.groupBy(*fine).agg(F.count(F.lit(1)).alias("n")), "fine-cells")
    up = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumns(
        {"cx": F.expr("shiftright(fx, k)"), "cy": F.expr("shiftright(fy, k)")}
    )
    coarse = [page, "k", "cx", "cy"]
    fitting = up.groupBy(*coarse).agg(F.sum("n").alias("total")).filter(F.col("total") <= size)
    leaf = up.join(fitting, coarse).groupBy(*fine).agg(F.max(F.struct("k", "cx", "cy")).alias("leaf"))
    placed = cells.join(leaf, fine, "left")
    parts = F.ceil(F.col("n") / size)
    own = F.concat_ws("/", F.lit("spot"), "fx", "fy", F.pmod(F.xxhash64(*SIDES), parts))
    at = F.concat_ws("/", "leaf.k", "leaf.cx", "leaf.cy")
    piece = F.when(F.col("leaf").isNull(), own).otherwise(at)
    return boxes.join(placed, fine).withColumn("piece", piece).drop("fx", "fy", "n", "leaf")


def in_pieces(boxes: DataFrame, page: str, size: int = PIECE) -> DataFrame:
    """``boxes`` with their ``piece`` and whether it is ``alone`` on its page."""
    crowded = crowded_pages(boxes, page, size)
    one = {"piece": F.lit(""), "alone": F.lit(True)}
    if crowded.isEmpty():
        return boxes.withColumns(one)
    cut = _quadtree(boxes.join(crowded, page, "left_semi"), page, size)
    rest = boxes.join(crowded, page, "left_anti").withColumns(one)
    return rest.unionByName(cut.withColumn("alone", F.lit(False)))


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions where another group begins; rows of a group follow each other."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for key in keys:
        column = rows.column(key).combine_chunks()
        ids = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= ids[1:] != ids[:-1]
    return np.flatnonzero(new)


def by_whole_groups(
    df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str
) -> DataFrame:
    """``work`` over tables of whole groups of ``keys``: it gets the rows, group
    after group, and where each group starts. A group has to fit into a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            if not rows.num_rows:
                continue
            starts = _starts(rows, keys)
            rest = rows.slice(starts[-1])
            if len(starts) > 1:
                yield from work(rows.slice(0, starts[-1]), starts[:-1]).to_batches()
        if rest is not None:
            yield from work(rest, np.zeros(1, np.int64)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def sides_of(rows: pa.Table) -> np.ndarray:
    return np.column_stack([rows.column(s).to_numpy().astype(np.float64) for s in SIDES])


def _spans(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of whole groups with about ``PAIRS`` pairs each."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    block = np.cumsum((ends - starts) ** 2) // PAIRS
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    last = np.r_[first[1:], len(starts)] - 1
    yield from zip(starts[first], ends[last])


def _pairs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of rows of a group, itself included, ordered by the first of
    them, and where the pairs of each row start."""
    start, size = np.unique(group, return_index=True, return_counts=True)[1:]
    size, start = np.repeat(size, size), np.repeat(start, size)
    begin = np.cumsum(size) - size
    left = np.repeat(np.arange(len(group)), size)
    right = np.arange(len(left)) - np.repeat(begin - start, size)
    return left, right, begin


def _distinct(boxes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((*boxes.T[::-1], group))
    boxes, group = boxes[order], group[order]
    new = np.r_[True, (group[1:] != group[:-1]) | (boxes[1:] != boxes[:-1]).any(axis=1)]
    return boxes[new], group[new]


def _hulls(boxes: np.ndarray, group: np.ndarray, gap: float) -> np.ndarray:
    left, right, begin = _pairs(group)
    a, b = boxes[left], boxes[right]
    meet = ((a[:, :2] - gap < b[:, 2:]) & (a[:, 2:] + gap > b[:, :2])).all(axis=1)
    meet |= left == right
    low = np.where(meet[:, None], b[:, :2], np.inf)
    high = np.where(meet[:, None], b[:, 2:], -np.inf)
    return np.hstack([np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin)])


def merged(boxes: np.ndarray, group: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Boxes of each group grown to the hull of what they come nearer than ``gap``
    to, until none grows; equal ones once. A settled group leaves the rounds."""
    settled = []
    boxes, group = _distinct(boxes, group)
    while len(boxes):
        grown = np.vstack([_hulls(boxes[i:j], group[i:j], gap) for i, j in _spans(group)])
        moving = np.isin(group, group[(grown != boxes).any(axis=1)])
        settled.append((boxes[~moving], group[~moving]))
        boxes, group = grown[moving], group[moving]
        if len(boxes):
            boxes, group = _distinct(boxes, group)
    if not settled:
        return boxes, group
    return np.vstack([b for b, _ in settled]), np.concatenate([g for _, g in settled])


def _conflicts(boxes: np.ndarray, group: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (earlier, later) that overlap by ``limit`` or more of the smaller."""
    left, right, _ = _pairs(group)
    left, right = left[left < right], right[left < right]
    a, b = boxes[left], boxes[right]
    sides = np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2])
    inter = np.where((sides > 0).all(axis=1), sides.prod(axis=1), 0.0)
    size = np.maximum(boxes[:, 2:] - boxes[:, :2], 0).prod(axis=1)
    small = np.minimum(size[left], size[right])
    hit = (inter > 0) & (inter / np.where(small > 0, small, 1.0) >= limit)
    return left[hit], right[hit]


def kept_greedily(boxes: np.ndarray, group: np.ndarray, limit: float) -> np.ndarray:
    """Which rows stay, where those of a group come in order of priority: a row
    stays if it overlaps every kept one before it by less than ``limit``. All rows
    that nothing open before them overlaps are decided at once."""
    found = [(i, *_conflicts(boxes[i:j], group[i:j], limit)) for i, j in _spans(group)]
    first = np.concatenate([i + a for i, a, _ in found])
    then = np.concatenate([i + b for i, _, b in found])
    waiting, kept = np.ones(len(boxes), bool), np.zeros(len(boxes), bool)
    while waiting.any():
        live = waiting[first] & waiting[then]
        first, then = first[live], then[live]
        wins = waiting.copy()
        wins[then] = False
        kept |= wins
        waiting &= ~wins
        waiting[then[wins[first]]] = False
    return kept

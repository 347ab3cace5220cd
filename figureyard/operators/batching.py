"""Assigning ordered items to count- and size-capped batches."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figureyard.operators.ranking import rank_within
from figureyard.session import materialised

# Pages and bytes per request batch, bytes per archive.
BATCH_PAGES, BATCH_BYTES, ARCHIVE_BYTES = 50, 20 * 1024 * 1024, 220 * 1024 * 1024

# neighbouring chunks that one task composes or starts
SCAN_FAN = 64


def page_batches(
    pages: DataFrame, group: str, order: list[Column], bucket: list[Column],
    max_pages: int = BATCH_PAGES, max_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Chunks of ``max_pages`` in order per group; a chunk above ``max_bytes``
    is halved until it fits or holds one page. All halvings of a chunk see at
    most ``max_pages`` rows and reuse the chunk's partitioning."""
    ranked = rank_within(pages, [group], order, bucket, name="__pos")
    out = ranked.withColumns(
        {
            "chunk": F.floor((F.col("__pos") - 1) / max_pages),
            "part": F.lit(""),
        }
    )
    rounds = max(1, int(np.ceil(np.log2(max_pages))))
    for _ in range(rounds):
        inside = Window.partitionBy(group, "chunk", "part")
        out = out.withColumns(
            {
                "__bytes": F.sum("bytes").over(inside),
                "__n": F.count(F.lit(1)).over(inside),
                "__i": F.row_number().over(inside.orderBy("__pos")),
            }
        ).withColumn(
            "part",
            F.when(
                (F.col("__bytes") > max_bytes) & (F.col("__n") > 1),
                F.concat(
                    "part", F.when(F.col("__i") <= F.floor(F.col("__n") / 2), "0").otherwise("1")
                ),
            ).otherwise(F.col("part")),
        )
    return out.drop("__bytes", "__n", "__i").withColumnRenamed("__pos", "pos")


def _offsets(size: np.ndarray, cap: float, carry: float) -> np.ndarray:
    """Batches closed before every item of a chunk; one step per batch."""
    prefix = np.concatenate([[0.0], np.cumsum(size)])
    offset = np.zeros(len(size), dtype=np.int64)
    begin, closed, need = 0, 0, cap - carry
    while begin < len(size):
        end = int(np.searchsorted(prefix, prefix[begin] + need, side="left"))
        offset[begin:end] = closed
        begin, closed, need = end, closed + 1, cap
    return offset


def _pieces(size: np.ndarray, cap: float) -> list[tuple[float, int, float]]:
    """A chunk as a step function of the bytes carried into it.

    Returns (smallest carry, batches closed, carry out or -1 for "carry in plus
    chunk"), ascending. Only the first place where a batch closes depends on the
    carry, and later places coincide for most carries, so few steps remain.
    """
    n = len(size)
    prefix = np.concatenate([[0.0], np.cumsum(size)])
    after = np.searchsorted(prefix, prefix[:n] + cap, side="left").tolist()
    closed, out = [0] * (n + 1), [0.0] * (n + 1)
    rest = (prefix[n] - prefix).tolist()
    for j in range(n - 1, -1, -1):
        if after[j] <= n:
            closed[j], out[j] = closed[after[j]] + 1, out[after[j]]
        else:
            out[j] = rest[j]
    steps = [(0.0, 0, -1.0)] if prefix[n] < cap else []
    for j in range(n, 0, -1):
        if cap - prefix[j - 1] <= 0:
            continue
        low = max(0.0, float(cap - prefix[j]))
        value = (closed[j] + 1, out[j])
        if steps and steps[-1][1:] == value:
            continue
        steps.append((low, *value))
    # the step that begins at carry 0 may be listed twice, keep the last
    kept: list[tuple[float, int, float]] = []
    for step in steps:
        if kept and kept[-1][0] == step[0]:
            kept[-1] = step
        else:
            kept.append(step)
    return kept


class Steps(NamedTuple):
    """Consecutive items as a step function of the bytes carried into them: from
    ``low`` on, ``closed`` batches close and ``carry`` bytes go on (-1: all that
    came in and the items' own ``size``; only the first step may be such)."""

    size: float
    low: np.ndarray
    closed: np.ndarray
    carry: np.ndarray

    def after(self, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = np.searchsorted(self.low, carried, side="right") - 1
        out = self.carry[hit]
        return self.closed[hit], np.where(out < 0, carried + self.size, out)

    def then(self, later: Steps, cap: float) -> Steps:
        """Both in a row. Composition is associative, so any tree of it gives the
        same function. It has no more steps than the two together, and no more
        than the first once that alone reaches ``cap``."""
        fixed = self.carry >= 0
        closed, carry = later.after(self.carry[fixed])
        low, closed = self.low[fixed], self.closed[fixed] + closed
        if not fixed[0]:
            # what came in reaches the later items whole, shifted by this size
            end = cap if len(self.low) == 1 else self.low[1]
            first = int(np.searchsorted(later.low, self.size, side="right")) - 1
            last = int(np.searchsorted(later.low, end + self.size, side="left"))
            low = np.concatenate([np.maximum(later.low[first:last] - self.size, 0.0), low])
            closed = np.concatenate([later.closed[first:last], closed])
            carry = np.concatenate([later.carry[first:last], carry])
        new = np.ones(len(low), dtype=bool)
        new[1:] = (closed[1:] != closed[:-1]) | (carry[1:] != carry[:-1])
        return Steps(self.size + later.size, low[new], closed[new], carry[new])


def _in_order(rows: pd.DataFrame) -> list[Steps]:
    part = rows.sort_values("at")
    return [Steps(*row) for row in zip(part["size"], part["low"], part["closed"], part["carry"])]


def carried_in(
    steps: DataFrame, cap: float, begin: DataFrame | None = None, fan: int = SCAN_FAN
) -> DataFrame:
    """What every chunk of a group starts from: (g, chunk, closed_before, carry_in),
    and one row with chunk null for what a group ends with.

    ``steps`` holds one row (g, chunk, size, low, closed, carry) a chunk, ``begin``
    (g, closed_before, carry_in) where a group does not start from nothing. The
    scan is a tree: ``fan`` neighbouring chunks compose to one function, these
    again, until a group has at most ``fan``; then the starts come down the same
    tree. No task's group holds more than ``fan`` functions, however many chunks
    there are; rounds grow with their logarithm.
    """
    g_type = steps.schema["g"].dataType.simpleString()
    block = F.expr(f"at div {fan}").alias("block")

    def compose(ids: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = reduce(lambda a, b: a.then(b, cap), _in_order(rows))
        return pd.DataFrame([(*ids, *whole)], columns=["g", "at", *Steps._fields])

    def hand_down(ids: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        begun, parts = rows[rows["at"].isna()], rows[rows["at"].notna()]
        done = int(begun["closed_before"].iloc[0]) if len(begun) else 0
        carry = float(begun["carry_in"].iloc[0]) if len(begun) else 0.0
        starts = []
        for at, part in zip(sorted(parts["at"]), _in_order(parts)):
            starts.append((ids[0], int(at), done, carry))
            closed, carried = part.after(np.array([carry]))
            done, carry = done + int(closed[0]), float(carried[0])
        starts.append((ids[0], None, done, carry))
        out = pd.DataFrame(starts, columns=["g", "at", "closed_before", "carry_in"])
        return out.astype({"at": "Int64"})

    ends = steps.agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).first()
    lo, top = ends["lo"] or 0, (ends["hi"] or 0) - (ends["lo"] or 0)
    level = steps.select("g", (F.col("chunk") - lo).cast("bigint").alias("at"), *Steps._fields)
    levels = [level.select("*", block)]
    while top >= fan:
        upper = levels[-1].groupBy("g", "block").applyInPandas(compose, level.schema)
        levels.append(materialised(upper, "scan-level").select("*", block))
        top //= fan
    begun = None if begin is None else begin.withColumn("block", F.lit(0).cast("bigint"))
    ended = None
    for functions in reversed(levels):
        rows = functions if begun is None else functions.unionByName(begun, allowMissingColumns=True)
        if begun is None:
            none = {"closed_before": F.lit(None).cast("bigint"), "carry_in": F.lit(None).cast("double")}
            rows = rows.withColumns(none)
        starts = materialised(rows.groupBy("g", "block").applyInPandas(
            hand_down, f"g {g_type}, at bigint, closed_before bigint, carry_in double"
        ), "scan-starts")
        ended = starts.filter("at IS NULL") if ended is None else ended
        begun = starts.filter("at IS NOT NULL").withColumnRenamed("at", "block")
    return begun.unionByName(ended.withColumnRenamed("at", "block")).withColumns(
        {"chunk": F.col("block") + lo}
    ).drop("block")


def size_capped_batches(
    items: DataFrame, group: str, key: str, size: str, bucket: Column, cap: int = ARCHIVE_BYTES,
    start: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Number the archives of every group: a batch closes at the first item that
    brings it to ``cap`` bytes or more; the last batch may stay below.

    ``start`` holds (group, closed, carry) of earlier items. Returns the numbered
    items and the same state after them.

    A running sum with reset is sequential, but a chunk of consecutive items is
    a small step function of the bytes carried in. Chunks are summarised in
    parallel, the functions are scanned by a tree (``carried_in``), and the
    chunks are then numbered in parallel. ``bucket`` names a row's chunk by whole
    numbers that grow with ``key``. Only (key, size) pairs travel.
    """
    pairs = items.select(
        F.col(group).alias("g"), F.col(key).alias("k"), F.col(size).cast("double").alias("s"),
        bucket.cast("bigint").alias("chunk"),
    )
    total = float(cap)

    def summarise(ids: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        data = rows.sort_values("k")["s"].to_numpy()
        low, closed, carry = zip(*_pieces(data, total))
        one = (*ids, float(data.sum()), np.array(low), np.array(closed), np.array(carry))
        return pd.DataFrame([one], columns=["g", "chunk", *Steps._fields])

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        offset = _offsets(rows["s"].to_numpy(), total, float(rows["carry_in"].iloc[0]))
        return pd.DataFrame(
            {
                "g": rows["g"].to_numpy(),
                "k": rows["k"].to_numpy(),
                "batch": rows["closed_before"].to_numpy() + offset + 1,
            }
        )

    g_type = items.schema[group].dataType.simpleString()
    k_type = items.schema[key].dataType.simpleString()
    steps = materialised(pairs.groupBy("g", "chunk").applyInPandas(
        summarise,
        f"g {g_type}, chunk bigint, size double, low array<double>, closed array<bigint>, carry array<double>",
    ), "archive-steps")
    begin = None
    if start is not None:
        begin = start.select(
            F.col(group).alias("g"), F.col("closed").alias("closed_before"), F.col("carry").alias("carry_in")
        )
    starts = carried_in(steps, total, begin)
    state = starts.filter(F.col("chunk").isNull()).select(
        F.col("g").alias(group), F.col("closed_before").alias("closed"), F.col("carry_in").alias("carry")
    )
    numbered = (
        pairs.join(starts, ["g", "chunk"])
        .groupBy("g", "chunk")
        .applyInPandas(number, f"g {g_type}, k {k_type}, batch long")
    )
    return numbered.select(F.col("g").alias(group), F.col("k").alias(key), "batch"), state


def archive_key(group: Column, batch: Column) -> Column:
    return F.format_string("v3/pdfs/%s/batch_%04d.zip", group, batch)

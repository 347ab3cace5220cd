"""Grey-level statistics of decoded crops.

Python only counts: a histogram of the levels, the mean step between
neighbours, and the number of different levels in a sparse sample. All measures
follow from the histogram by array functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Thresholds of the grey-level measures.
OFF_MODE, LIGHT, DARK, COLOUR_STEP = 16, 240, 32, 7
LEVELS = 256
SLICE = 256  # crops whose counts are held together

COUNTS = (
    T.StructType()
    .add("hist", T.ArrayType(T.IntegerType()))
    .add("edge", T.DoubleType())
    .add("colors", T.IntegerType())
)


def counted(blob: bytes | None, width: int) -> tuple:
    """Histogram, mean step to the pixel below plus mean step to the right, and
    levels seen in every seventh pixel. A ragged last row has no steps."""
    if blob is None:
        return None, None, None
    flat = np.frombuffer(blob, np.uint8).astype(np.int16)
    whole = flat[: len(flat) - len(flat) % width]
    below = np.abs(whole[width:] - whole[:-width]) if len(whole) > width else whole[:0]
    right = np.abs(whole[1:] - whole[:-1])
    right = right[np.arange(1, len(whole)) % width != 0] if len(whole) else right
    steps = sum(float(s.mean()) for s in (below, right) if len(s))
    seen = np.bincount(flat[::COLOUR_STEP], minlength=LEVELS)
    return np.bincount(flat, minlength=LEVELS).astype(np.int32), steps, int((seen > 0).sum())


def counted_slice(blobs: pa.Array, widths: pa.Array) -> pa.Array:
    """``counted`` of a few crops as structs."""
    rows = [counted(b, int(w)) for b, w in zip(blobs.to_pylist(), widths.to_pylist())]
    hist, edge, colors = zip(*rows)
    columns = [pa.array(hist, pa.list_(pa.int32())), pa.array(edge, pa.float64()), pa.array(colors, pa.int32())]
    return pa.StructArray.from_arrays(columns, names=COUNTS.names)


@F.arrow_udf(COUNTS)
def pixel_counts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A batch of crops holds as many rows as Spark sends; its counts go out slice
    by slice, so that a task never holds those of a whole batch."""
    for blobs, widths in batches:
        for at in range(0, len(blobs), SLICE):
            yield counted_slice(blobs.slice(at, SLICE), widths.slice(at, SLICE))


def measures(c: Column) -> Column:
    """std, content_frac, edge, colors, light_frac and dark_frac of counts. An
    empty crop measures 0; the smallest most frequent level is the mode."""
    hist, zero = c["hist"], F.lit(0.0)

    # bound once: an expression inside a lambda is evaluated for each element
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def of(levels: Column, n: Column) -> Column:
        def share(which) -> Column:
            some = _total(levels, lambda h, level: F.when(which(level), h).otherwise(zero))
            return F.when(n > 0, some / n).otherwise(zero)

        def spread(m: Column) -> Column:
            return F.sqrt(_total(levels, lambda h, level: h * (level - m) * (level - m)) / n)

        mode = F.array_position(hist, F.array_max(hist)) - 1
        mean = _total(levels, lambda h, level: h * level) / n
        return F.struct(
            F.when(n > 0, once(mean, spread)).otherwise(zero).alias("std"),
            once(mode, lambda m: share(lambda level: F.abs(level - m) > OFF_MODE)).alias("content_frac"),
            c["edge"].alias("edge"),
            c["colors"].alias("colors"),
            share(lambda level: level > LIGHT).alias("light_frac"),
            share(lambda level: level < DARK).alias("dark_frac"),
        )

    def whole(levels: Column) -> Column:
        return once(_total(levels, lambda h, level: h), lambda n: of(levels, n))

    return F.when(hist.isNotNull(), once(held_levels(hist), whole))


def held_levels(hist: Column) -> Column:
    """Counts with their levels. Levels without a pixel, mostly the larger part, add
    nothing to any sum and are left out once."""
    both = F.transform(hist, lambda h, level: F.struct(h.cast("double").alias("h"), level.alias("level")))
    return F.filter(both, lambda x: x["h"] > 0)


def _total(levels: Column, weigh: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda a, x: a + weigh(x["h"], x["level"]))


def pixel_stats(blob: Column | str, width: Column) -> Column:
    return F.get(F.transform(F.array(pixel_counts(blob, width)), measures), F.lit(0))


def crop_features(size: Column, width: Column, height: Column, stats: Column) -> dict[str, Column]:
    """The ten features of a crop, in their order."""
    longer, shorter = F.greatest(width, height), F.least(width, height)
    shape = {
        "bytes": size, "width": width, "height": height,
        "aspect": longer / F.greatest(F.lit(1), shorter),
    }
    tones = ("std", "content_frac", "edge", "colors", "light_frac", "dark_frac")
    return shape | {name: stats[name] for name in tones}

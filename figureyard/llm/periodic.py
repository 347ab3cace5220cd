"""Periodic runs: stretches of words that repeat with a period.

A run is a stretch with smallest period q (words q apart are identical) of at
least ``TIMES`` periods and ``LEAST`` words which no neighbouring word extends.

1. Recursive frequency splitting. Every word of a run occurs at least ``TIMES``
   times in it, so a word that occurs more rarely in the current segment stands in
   no run there and splits the segment. Counts are taken again in the parts, until
   no part changes; parts under ``LEAST`` words go. A run is never cut, and a word
   that splits never extends one.
2. Lag scan of what survives. For every lag q, anchors stand q words apart. A run
   of four periods holds an anchor a where the 2q words from a equal those from
   a + q; sums of keyed words compare them at once, the words themselves confirm.
   Anchors of one lag that follow each other are one run, which is then extended
   to both sides by less than a lag. Anchors inside a run of a smaller period are
   left out: there the lag is a multiple of that period. The number of anchors is
   n (1 + 1/2 + 1/3 + ...), so a text of one word repeated stays cheap too.

Runs of a text may overlap. ``collapsed`` keeps the first period of each run and
drops the rest of it.

Null and empty texts, and texts of white space, have no words, no runs and an
empty collapsed text. Rows that repeat count each; extra columns are ignored; an
empty table gives an empty result. Texts are handled in groups of bounded size,
a longer text alone. No shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figureyard.llm.common import let, table, words_of

TIMES, LEAST = 4, 6
GROUP = 1 << 19  # words handled together
FACTOR = np.uint64(0x9E3779B97F4A7C15)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def counts(keys: np.ndarray) -> np.ndarray:
    """For each element how often its value occurs."""
    order = np.argsort(keys)
    k = keys[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), len(k)]
    out = np.empty(len(k), np.int64)
    out[order] = np.repeat(np.diff(cuts), np.diff(cuts))
    return out


def segments(ids: np.ndarray, text: np.ndarray, times: int = TIMES, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """(start, end) of the segments in which each word occurs ``times`` times.

    ``text`` numbers the texts, ascending, that the words ``ids`` belong to.
    """
    at, part, top = np.arange(len(ids)), text.astype(np.int64), int(ids.max(initial=0)) + 1
    cuts = np.array([0])
    while len(at):
        often = counts(part * top + ids[at]) >= times
        done = often.all()
        at, part = at[often], part[often]
        cuts = np.r_[0, np.flatnonzero((np.diff(at) != 1) | (np.diff(part) != 0)) + 1, len(at)] if len(at) else np.array([0])
        sizes = np.diff(cuts)
        if done and (sizes >= least).all():
            break
        stays = np.repeat(sizes >= least, sizes)
        part = np.repeat(np.arange(len(sizes)), sizes)[stays]
        at = at[stays]
    if len(at):
        yield from zip(at[cuts[:-1]].tolist(), (at[cuts[1:] - 1] + 1).tolist())


def runs(x: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``x``, by start, then period."""
    n = len(x)
    keyed = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    keyed ^= keyed >> np.uint64(32)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(n, FACTOR)])
    sums = np.r_[np.uint64(0), np.cumsum(keyed * powers[:n])]
    found: list[tuple[int, int, int]] = []
    low = 1
    while low <= n // times:
        # no lag below twice this one is its multiple
        lags = np.arange(low, min(2 * low, n // times + 1))
        each = n // lags - 2
        q = np.repeat(lags, each)
        a = (np.arange(len(q)) - np.repeat(np.cumsum(each) - each, each)) * q
        same = (sums[a + 2 * q] - sums[a]) * powers[q] == sums[a + 3 * q] - sums[a + q]
        q, a = q[same], a[same]
        if found and len(a):
            starts, ends = np.array(sorted((s, s + m) for s, m, _ in found)).T
            reach = np.r_[0, np.maximum.accumulate(ends)]
            outside = reach[np.searchsorted(starts, a, "right")] < a + 3 * q
            q, a = q[outside], a[outside]
        cuts = np.flatnonzero((q[1:] != q[:-1]) | (a[1:] != a[:-1] + q[:-1])) + 1 if len(q) else []
        for chain in np.split(np.arange(len(q)), cuts) if len(q) else []:
            lag, first, last = int(q[chain[0]]), int(a[chain[0]]), int(a[chain[-1]])
            for b, c in [(first, last)] if holds(x, lag, first, last) else [(int(v), int(v)) for v in a[chain] if holds(x, lag, int(v), int(v))]:
                found.append(extended(x, lag, b, c))
        low *= 2
    return sorted({(s, m, p) for s, m, p in found if m >= max(least, times * p)}, key=lambda r: (r[0], r[2]))


def holds(x: np.ndarray, lag: int, first: int, last: int) -> bool:
    return np.array_equal(x[first : last + 2 * lag], x[first + lag : last + 3 * lag])


def extended(x: np.ndarray, lag: int, first: int, last: int) -> tuple[int, int, int]:
    """The run of period ``lag`` whose anchors reach from ``first`` to ``last``."""
    step, start, end = max(lag, 16), first, last + 3 * lag
    while start > 0:
        b = max(0, start - step)
        odd = np.flatnonzero(x[b:start] != x[b + lag : start + lag])
        start = b + int(odd[-1]) + 1 if len(odd) else b
        if len(odd):
            break
    while end < len(x):
        e = min(len(x), end + step)
        odd = np.flatnonzero(x[end:e] != x[end - lag : e - lag])
        end = end + int(odd[0]) if len(odd) else e
        if len(odd):
            break
    return start, end - start, lag


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without what repeats a run's first period."""
    if found:
        keep = np.ones(len(words), bool)
        for start, length, period in found:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the
    collapsed text of every row of ``docs``."""
    schema = pa.schema(
        [("doc_id", docs.select("doc_id").limit(0).toArrow().schema.field(0).type), ("n_words", pa.int64()),
         ("runs", pa.list_(RUN)), ("collapsed", pa.string())]
    )

    def scanned(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        flat = np.array([numbers[w] for t in texts for w in t], np.int64)
        sizes = [len(t) for t in texts]
        first = np.r_[0, np.cumsum(sizes)]
        found: list[list] = [[] for _ in texts]
        for start, end in segments(flat, np.repeat(np.arange(len(texts)), sizes), times, least):
            t = int(np.searchsorted(first, start, "right")) - 1
            found[t] += [(start - int(first[t]) + s, m, p) for s, m, p in runs(flat[start:end], times, least)]
        rows = [sorted(f, key=lambda r: (r[0], r[2])) for f in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, schema.field(0).type), pa.array(sizes, pa.int64()),
             pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in rows], pa.list_(RUN)),
             pa.array([collapsed(t, f).decode("utf-8", "surrogatepass") for t, f in zip(texts, rows)], pa.string())],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, held = [], [], 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if ids and (held + len(words) > group or len(ids) >= 2048):
                    yield scanned(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc)
                texts.append(words)
                held += len(words)
            if ids:
                yield scanned(ids, texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which, for a tenth of the ids, the words from a place on repeat
    with a period; both follow from the id. Null ids change nothing."""
    h = F.crc32(doc_id.cast("string"))

    def tiled(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " "))

    return F.when(h % 10 == 0, let(words_of(text), tiled)).otherwise(text)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    lines = F.array_join(
        F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

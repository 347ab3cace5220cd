"""Homomorphic multiset fingerprints of documents.

A paragraph (a line) hashes to a wide vector of +1 and -1; the fingerprint of a
text is the sum of its paragraphs' vectors modulo 2**16. So the order of
paragraphs does not matter, equal multisets have equal fingerprints, and a
paragraph is inserted or deleted by adding or subtracting its vector. A long
paragraph also contributes its sentences and, from each sentence's start, blocks
of ``BLOCK`` characters, so that an edit inside it leaves most of it in place.

As the vectors are independent, the inner product of two fingerprints estimates
what both texts share: likeness is 2 ab / (aa + bb), cut to 0..1.

For the edited texts every document needs the start of the next one. Documents
are dealt once, by ranges of doc_id; the first document of a range is also sent
to the range before it. Ranges are cut at quantiles; what meets in the driver is
a number or two for each.

A null text is empty, an empty text is one empty paragraph. Rows that share a
doc_id follow each other by a hash of their text; a null doc_id comes first. A
single document is its own next. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figureyard.llm.common import table

WIDTH = 256
BLOCK = 16
SENTENCE = re.compile(r"(?<=[.!?]) ")
SMALLEST = -(1 << 63)


def units(paragraph: str) -> list[bytes]:
    """What a paragraph contributes: itself and, if long, its parts."""
    out = ["\n" + paragraph]
    if len(paragraph) > BLOCK:
        for s in SENTENCE.split(paragraph):
            out += [s[i : i + BLOCK] for i in range(0, max(1, len(s)), BLOCK)]
    return [u.encode("utf-8", "surrogatepass") for u in out]


def summed(parts: list[bytes]) -> np.ndarray:
    """Sum of the parts' vectors as int16, that is modulo 2**16."""
    total = np.zeros(WIDTH, np.int64)
    for i in range(0, len(parts), 4096):
        some = [hashlib.blake2b(p, digest_size=WIDTH // 8).digest() for p in parts[i : i + 4096]]
        bits = np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(-1, WIDTH // 8), axis=1)
        total += 2 * bits.sum(0, dtype=np.int64) - len(some)
    return total.astype(np.int16)


def fingerprint(text: str | None) -> np.ndarray:
    return summed([u for p in (text or "").split("\n") for u in units(p)])


def inserted(fp: np.ndarray, paragraph: str) -> np.ndarray:
    return fp + summed(units(paragraph))


def deleted(fp: np.ndarray, paragraph: str) -> np.ndarray:
    return fp - summed(units(paragraph))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    x, y = a.astype(np.float64), b.astype(np.float64)
    both = float(x @ x + y @ y)
    return 1.0 if both == 0 else min(1.0, max(0.0, 2 * float(x @ y) / both))


def shown(fp: np.ndarray) -> str:
    return base64.b64encode(fp.astype("<i2").tobytes()).decode()


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def with_next(docs: DataFrame) -> DataFrame:
    """The columns of ``OUT`` for every row."""
    spark = docs.sparkSession
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(order.cast("double").alias("id"))
    # a boundary for each range
    cuts = sorted(set(ids.approxQuantile("id", [k / parts for k in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    bounds = np.array([int(c) for c in cuts], np.int64)
    lowest = pa.schema([("range", pa.int64()), ("id", pa.int64())])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The smallest id of each range, ranges starting above their bound."""
        for b in batches:
            at = np.sort(b.column("_id").to_numpy())
            home, first = np.unique(np.searchsorted(bounds, at, side="left"), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int64()), pa.array(at[first], pa.int64())], schema=lowest)

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), order.alias("_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    # the first id of each range in use: at most a row for each range
    homes = rows.select("_id").mapInArrow(least, "range long, id long")
    heads = sorted((r["range"], r["id"]) for r in homes.groupBy("range").agg(F.min("id").alias("id")).collect())
    before = {heads[k][1]: heads[k - 1][0] for k in range(len(heads))}
    firsts = [h[1] for h in heads]
    schema = pa.schema([(c, pa.int64()) for c in ("part", "peek", "doc_id", "id", "h")] + [("text", pa.string())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their range; the first of a range once more, for the one before."""
        for b in batches:
            doc, at, text, h = (b.column(c).to_pylist() for c in ("doc_id", "_id", "text", "h"))
            homes = [heads[bisect_right(firsts, i) - 1][0] for i in at]
            take = [(k, homes[k], 0) for k in range(len(at))]
            take += [(k, before[i], 1) for k, i in enumerate(at) if i in before]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for _, p, _ in take], pa.int64()), pa.array([x for _, _, x in take], pa.int64()),
                 pa.array([doc[k] for k, _, _ in take], pa.int64()), pa.array([at[k] for k, _, _ in take], pa.int64()),
                 pa.array([h[k] for k, _, _ in take], pa.int64()), b.column("text").take(pa.array([k for k, _, _ in take]))],
                schema=schema,
            )

    dealt = (
        rows.mapInArrow(deal, "part long, peek long, doc_id long, id long, h long, text string")
        .repartitionById(parts, F.col("part").cast("int"))
        .sortWithinPartitions("part", "peek", "id", "h")
    )
    out = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, peeked = None, False
        for b in batches:
            found = []
            for part, peek, doc, text in zip(*(b.column(c).to_pylist() for c in ("part", "peek", "doc_id", "text"))):
                fp = fingerprint(text)
                if last and not (peek and peeked):
                    changed = edited(last[1], text)
                    efp = fingerprint(changed)
                    found.append(
                        (last[0], len(last[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                         shown(last[2]), shown(efp), likeness(last[2], efp), likeness(last[2], fp))
                    )
                peeked = bool(peek)
                last = None if peek else (doc, text, fp)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), out)], schema=out)

    return dealt.select("part", "peek", "doc_id", "text").mapInArrow(follow, OUT)


def query(spark, folder: str) -> DataFrame:
    return with_next(table(spark, folder, "documents"))

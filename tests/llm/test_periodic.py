"""Periodic runs against the definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from figureyard.llm.periodic import periodic_runs, planted, query, runs, segments
from pyspark.sql import functions as F


def by_definition(x: list) -> list[tuple[int, int, int]]:
    """Each lag, each maximal stretch; smallest period by trying all below."""
    n, found = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            y = x[i : i + length]
            least = next(p for p in range(1, q + 1) if y[p:] == y[:-p])
            if length >= max(6, 4 * q) and least == q:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def in_segments(x: list) -> list[tuple[int, int, int]]:
    a = np.array(x, np.int64)
    found = []
    for s, e in segments(a, np.zeros(len(a), int)):
        found += [(s + i, m, p) for i, m, p in runs(a[s:e])]
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(300))
def test_runs_are_those_of_the_definition(seed):
    r = random.Random(seed)
    x: list[int] = []
    while len(x) < r.randint(0, 120):
        if r.random() < 0.6:
            base = [r.randint(0, r.choice([1, 2, 9])) for _ in range(r.randint(1, 7))]
            x += (base * 9)[: r.randint(1, 9 * len(base))]
        else:
            x.append(r.randint(0, 30))
    assert in_segments(x) == by_definition(x)
    assert runs(np.array(x, np.int64)) == by_definition(x)


def test_nested_and_binary_texts():
    tm = [bin(i).count("1") % 2 for i in range(4096)]  # no cube anywhere
    assert in_segments(tm) == []
    block = [1] * 7 + [2]
    x = block * 5
    assert in_segments(x) == by_definition(x)
    assert len(in_segments(x)) == 6


def test_one_word_for_ever():
    x = [5] * 300_000
    assert in_segments(x) == [(0, 300_000, 1)]
    y = list(range(50_000)) * 4 + [7, 7]
    assert in_segments(y) == [(0, 200_000, 50_000)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = by_definition(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def test_query_against_the_definition(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    key = lambda r: (r[0] is not None, r[0], r[6])
    want = sorted((expected(d["doc_id"], d["text"]) for d in docs), key=key)
    assert sorted(map(tuple, query(spark, folder).collect()), key=key) == want
    assert sum(r[1] for r in want) > 10


def test_odd_rows(odd_docs, no_docs):
    text = planted(F.col("doc_id"), F.col("text"))
    rows = periodic_runs(odd_docs.withColumn("text", text)).collect()
    assert len(rows) == 8
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_words"] == by[3]["n_words"] == by[5]["n_words"] == 0 and by[2]["collapsed"] == ""
    assert [tuple(r) for r in by[4]["runs"]] == [(0, 24_000, 4)] and by[4]["collapsed"] == "Long words stand here."
    assert periodic_runs(no_docs).collect() == []
    alone = periodic_runs(odd_docs.withColumn("text", text), group=10).collect()
    assert sorted(map(str, alone)) == sorted(map(str, rows))

import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from figureyard.operators import batching
from figureyard.operators.ranking import id_bucket


def _sequential(rows, cap):
    out, state = {}, {}
    for g, k, s in sorted(rows):
        closed, carry = state.get(g, (0, 0))
        out[(g, k)] = closed + 1
        carry += s
        state[g] = (closed + 1, 0) if carry >= cap else (closed, carry)
    return out, state


@pytest.mark.parametrize("width,top", [(16, 60), (7, 5), (64, 300), (1000, 60)])
def test_archives_equal_a_sequential_run(spark, width, top):
    rnd = random.Random(width)
    rows = [("hot", k, rnd.randint(0, top)) for k in range(400)]
    rows += [("cold", k, rnd.randint(0, top)) for k in range(0, 90, 3)]
    df = spark.createDataFrame(rows, "g string, k long, s long")
    out, state = batching.size_capped_batches(df, "g", "k", "s", id_bucket(F.col("k"), width), 100)
    want, end = _sequential(rows, 100)
    assert {(r.g, r.k): r.batch for r in out.collect()} == want
    assert {r.g: (r.closed, r.carry) for r in state.collect()} == end


def test_archives_continue_from_a_state(spark):
    rnd = random.Random(9)
    rows = [("a", k, rnd.randint(0, 70)) for k in range(120)]
    want, _ = _sequential(rows, 100)
    got, state = {}, None
    for lo in (0, 50, 90):
        hi = {0: 50, 50: 90, 90: 120}[lo]
        df = spark.createDataFrame(rows[lo:hi], "g string, k long, s long")
        out, state = batching.size_capped_batches(
            df, "g", "k", "s", id_bucket(F.col("k"), 16), 100, state
        )
        got.update({(r.g, r.k): r.batch for r in out.collect()})
    assert got == want


def _steps(sizes, cap):
    low, closed, carry = map(np.array, zip(*batching._pieces(np.array(sizes, dtype=float), cap)))
    return batching.Steps(float(sum(sizes)), low, closed, carry)


def _run(sizes, cap, carry):
    closed = 0
    for s in sizes:
        carry += s
        if carry >= cap:
            closed, carry = closed + 1, 0
    return closed, carry


@pytest.mark.parametrize("top", [1, 8, 40, 130])
def test_composed_steps_equal_a_sequential_run_from_every_carry(top):
    rnd = random.Random(top)
    for _ in range(60):
        chunks = [[rnd.randint(0, top) for _ in range(rnd.randint(1, 9))] for _ in range(6)]
        parts = [_steps(c, 100.0) for c in chunks]
        left = reduce(lambda a, b: a.then(b, 100.0), parts)
        pairs = [parts[i].then(parts[i + 1], 100.0) for i in (0, 2, 4)]
        tree = pairs[0].then(pairs[1].then(pairs[2], 100.0), 100.0)
        sizes = [s for c in chunks for s in c]
        for carry in range(100):
            want = _run(sizes, 100, carry)
            for made in (left, tree):
                closed, out = made.after(np.array([float(carry)]))
                assert (closed[0], out[0]) == want
        assert len(left.low) <= sum(len(p.low) for p in parts)


def test_scan_of_a_category_of_100000_chunks(spark, monkeypatch):
    """One item a chunk, so its function is known in SQL; no group above the fan."""
    n, cap, size = 100_000, 100, "CAST(1 + pmod(chunk * 7919, 53) AS DOUBLE)"
    rows = spark.sql(
        f"""SELECT 'hot' AS g, id - 3 AS chunk FROM range(0, {n}, 1, 8)
            UNION ALL SELECT 'cold', id * 70 FROM range(900)"""
    )
    steps = rows.selectExpr(
        "g", "chunk", f"{size} AS size", f"array(0D, {cap} - {size}) AS low",
        "array(0L, 1L) AS closed", "array(-1D, 0D) AS carry",
    )
    fold = batching._in_order

    def counted(part):
        assert len(part) <= batching.SCAN_FAN
        return fold(part)

    monkeypatch.setattr(batching, "_in_order", counted)
    begin = spark.createDataFrame(
        [("cold", 5, 40.0), ("idle", 2, 9.0)], "g string, closed_before long, carry_in double"
    )
    got = batching.carried_in(steps, float(cap), begin)
    for g, keys, (closed, carry) in (
        ("hot", range(-3, n - 3), (0, 0.0)), ("cold", range(0, 63_000, 70), (5, 40.0)), ("idle", (), (2, 9.0))
    ):
        found = {r.chunk: (r.closed_before, r.carry_in) for r in got.filter(F.col("g") == g).collect()}
        assert len(found) == len(keys) + 1
        for k in keys:
            assert found[k] == (closed, carry)
            carry += 1 + k * 7919 % 53
            if carry >= cap:
                closed, carry = closed + 1, 0.0
        assert found[None] == (closed, carry)


def _halve(sizes, cap):
    if sum(sizes) <= cap or len(sizes) <= 1:
        return [sizes]
    mid = len(sizes) // 2
    return _halve(sizes[:mid], cap) + _halve(sizes[mid:], cap)


def test_page_batches_halve_until_they_fit(spark):
    rnd = random.Random(4)
    sizes = [rnd.choice([1, 5, 40, 900]) for _ in range(137)]
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(sizes)], "f string, k long, bytes long")
    cut = batching.page_batches(df, "f", [F.col("k")], [id_bucket(F.col("k"), 20)], 50, 1000)
    rows = sorted((r.chunk, r.part, r.k, r.bytes) for r in cut.collect())
    got = {}
    for chunk, part, _, size in rows:
        got.setdefault((chunk, part), []).append(size)
    want = [b for i in range(0, len(sizes), 50) for b in _halve(sizes[i:i + 50], 1000)]
    assert [got[k] for k in sorted(got)] == want


def test_archive_key(spark):
    row = spark.range(1).select(batching.archive_key(F.lit("robots"), F.lit(7)).alias("k")).first()
    assert row.k == "v3/pdfs/robots/batch_0007.zip"

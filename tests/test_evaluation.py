import random

import numpy as np
from pyspark.sql import functions as F

from figureyard.operators import evaluation as ev


def _spread(spark, counts):
    rows = [(a, b) for a, b, n in counts for _ in range(n)]
    return spark.createDataFrame(rows, "a string, b string")


def test_kappa_of_the_published_ratings(spark):
    crops = [
        ("data_plot", "data_plot", 81), ("data_plot", "diagram", 3), ("data_plot", "photo", 2),
        ("diagram", "data_plot", 2), ("diagram", "diagram", 89), ("fragment_junk", "diagram", 1),
        ("fragment_junk", "fragment_junk", 4), ("fragment_junk", "photo", 1), ("photo", "photo", 17),
    ]
    pages = [("0", "0", 80), ("0", "1", 5), ("1", "0", 5), ("1", "1", 30)]
    binary = [("d" if a == "diagram" else "x", "d" if b == "diagram" else "x", n) for a, b, n in crops]
    results = [ev.kappa(_spread(spark, c), "a", "b").first() for c in (crops, binary, pages)]
    assert [r.kappa for r in results] == [0.9251, 0.9396, 0.7983]
    assert [r.disagreements for r in results] == [9, 6, 10]


def test_mcnemar_of_the_published_counts(spark):
    rows = [(1, 1, 0)] * 27 + [(1, 0, 1)] * 6 + [(1, 1, 1)] * 100
    df = spark.createDataFrame(rows, "y int, a int, b int")
    out = ev.mcnemar(df, F.col("y"), F.col("a"), F.col("b")).first()
    assert (out.n10, out.n01) == (27, 6)
    assert abs(out.stat - 400 / 33) < 1e-9
    assert abs(out.p - 0.0005) < 5e-5
    same = ev.mcnemar(df.filter("a = b"), F.col("y"), F.col("a"), F.col("b")).first()
    assert same.p == 1.0


def test_metrics_without_positives_are_zero(spark):
    df = spark.createDataFrame([(False, False)] * 3, "y boolean, p boolean")
    out = ev.binary_metrics(df, F.col("y"), F.col("p")).first()
    assert (out.acc, out.precision, out.recall, out.f1, out.n) == (1.0, 0.0, 0.0, 0.0, 3)


def test_large_bootstrap_draws_the_same_distribution(spark):
    small = spark.createDataFrame([(4000, 500, 500, 5000)], "tp long, fp long, fn long, tn long")
    big = small.select(*[(F.col(c) * 4).alias(c) for c in ev.CELLS])
    a = ev.bootstrap(small, ev.METRICS["acc"], resamples=300).first()
    b = ev.bootstrap(big, ev.METRICS["acc"], resamples=2000).first()
    assert abs((a.lo + a.hi) / 2 - 0.9) < 0.002 and abs((b.lo + b.hi) / 2 - 0.9) < 0.002
    # four times the rows halve the interval
    assert 1.6 < (a.hi - a.lo) / (b.hi - b.lo) < 2.4


def test_empty_bootstrap_returns_a_row(spark):
    none = spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, fn long, tn long")
    assert ev.bootstrap(none, ev.METRICS["acc"]).count() == 1


def _bands(rows, grid, target):
    table = []
    for lo in grid:
        for hi in [h for h in grid if h >= lo]:
            acc = [y for p, y in rows if p >= hi]
            dec = [(p, y) for p, y in rows if p >= hi or p <= lo]
            if len(dec) < len(rows) * 0.3:
                continue
            right = sum((p >= hi and y) or (p <= lo and not y) for p, y in dec)
            table.append((lo, hi, round(len(dec) / len(rows), 4), round(right / len(dec), 4),
                          round(sum(acc) / len(acc), 4) if acc else 0))
    ok = [t for t in table if t[4] >= target]
    return table, max(ok, key=lambda t: t[2]) if ok else max(table, key=lambda t: t[4])


def test_band_sweep_counts_edges_twice_and_first_best_wins(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 40) / 40, rnd.random() < 0.5) for _ in range(300)]
    rows += [(0.5, True), (0.5, False), (0.05, True), (0.95, False)]
    df = spark.createDataFrame(rows, "p double, y boolean")
    grid = ev.grid_points()
    for target in (0.45, 0.99):
        table = ev.band_sweep(df, F.col("y"), "p", target)
        got = {(r.lo, r.hi): (r.coverage, r.decided_acc, r.accept_precision) for r in table.collect()}
        want, best = _bands(rows, grid, target)
        assert set(got) == {(t[0], t[1]) for t in want}
        for t in want:
            assert np.allclose(got[(t[0], t[1])], t[2:], atol=1.01e-4)
        top = ev.best_band(table).first()
        assert (top.lo, top.hi) == best[:2]


def test_detector_sweep_equals_the_gate_per_page(spark):
    rnd = random.Random(8)
    rows = []
    for page in range(60):
        for _ in range(rnd.randint(1, 4)):
            rows.append((page, rnd.choice(["figure", "table"]), rnd.randint(1, 9) / 10, 0, 0,
                         rnd.randint(20, 300), rnd.randint(20, 300), page % 2, 612, 792))
    df = spark.createDataFrame(
        rows, "page long, cls string, conf double, x0 int, y0 int, x1 int, y1 int, has_diagram int, w int, h int"
    )
    out = ev.detector_sweep(df, "page").collect()
    assert len(out) == 15
    for r in out:
        hits = {x[0] for x in rows if x[1] == "figure" and x[2] >= r.conf_t
                and x[5] * x[6] >= r.area_t * 612 * 792}
        right = sum((p in hits) == (p % 2 == 1) for p in range(60))
        assert abs(r.acc - right / 60) < 1e-4
    assert ev.first_best(ev.detector_sweep(df, "page"), "f1", "ord").first().f1 == max(r.f1 for r in out)


def test_confusion_keeps_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 2)], "y int, p int")
    out = {r.truth: tuple(r)[1:] for r in ev.confusion(df, "y", "p").collect()}
    assert out == {0: (1, 1, 0, 0), 1: (0, 0, 0, 0), 2: (0, 0, 1, 0), 3: (0, 0, 0, 0)}


def test_small_slices_are_left_out_and_unknown_is_named(spark):
    rows = [("a", 1, 1)] * 10 + [("b", 1, 1)] * 9 + [(None, 1, 0)] * 12
    df = spark.createDataFrame(rows, "f string, y int, p int")
    out = {r.f: (r.acc, r.n) for r in ev.slices(df, "f", F.col("y"), F.col("p")).collect()}
    assert out == {"a": (1.0, 10), "?": (0.0, 12)}


def test_intervals_of_groups_are_those_of_each(spark):
    rows = [("a", 40, 5, 5, 50), ("b", 400, 50, 50, 500), ("none", 0, 0, 0, 0)]
    counts = spark.createDataFrame(rows, "judge string, tp long, fp long, fn long, tn long")
    out = {r.judge: r for r in ev.grouped_intervals(counts, ["judge"], ev.METRICS).collect()}
    for name, n in (("a", 100), ("b", 1000)):
        r = out[name]
        assert r.acc_lo <= 0.9 <= r.acc_hi
        assert abs((r.acc_hi - r.acc_lo) / (2 * 1.96 * (0.09 / n) ** 0.5) - 1) < 0.2
    alone = ev.bootstrap(counts.where("judge = 'a'").drop("judge"), ev.METRICS["acc"]).first()
    assert (alone.lo, alone.hi) == (out["a"].acc_lo, out["a"].acc_hi)


def test_report_of_two_sides_against_resampled_rows(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 4, 400)
    p = np.where(rng.random(400) < 0.7, y, rng.integers(0, 4, 400))
    fields = [None if i % 3 == 0 else f"f{i % 3}" for i in range(400)]
    rows = [("m", "silver", int(a), int(b), f) for a, b, f in zip(y, p, fields)]
    rows += [("m", "gold", 0, 0, "few")] * 9 + [("m", "gold", None, 0, "few"), ("m", "gold", 0, None, "few")]
    df = spark.createDataFrame(rows, "name string, side string, y4 int, pred4 int, field string")
    out = {r.side: r for r in ev.evaluation_report(df).collect()}
    r = out["silver"]
    assert r.n == 400 and r.acc4 == round(float((y == p).mean()), 4)
    assert [[int(((y == i) & (p == j)).sum()) for j in range(4)] for i in range(4)] == r.confusion
    assert {s.field for s in r.slices} == {"?", "f1", "f2"} and sum(s.n for s in r.slices) == 400
    yb, pb = y == 0, p == 0
    drawn = []
    for _ in range(1000):
        s = rng.integers(0, 400, 400)
        tp = (yb[s] & pb[s]).sum()
        drawn.append(((yb[s] == pb[s]).mean(), 2 * tp / (yb[s].sum() + pb[s].sum())))
    want = np.percentile(drawn, [2.5, 97.5], axis=0)
    assert np.allclose([[r.acc_lo, r.f1_lo], [r.acc_hi, r.f1_hi]], want, atol=0.015)
    g = out["gold"]
    assert (g.n, g.acc, g.f1, g.slices, g.acc_lo) == (9, 1.0, 1.0, [], 1.0)

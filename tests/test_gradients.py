"""Fits on summed gradients, against plain numpy and the library's own probe."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from figureyard.operators import gradients, models


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 4, 600)
    return rng.normal(size=(4, 6))[y] * 1.2 + rng.normal(size=(600, 6)), y


@pytest.fixture(scope="module")
def table(spark, clouds):
    x, y = clouds
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "image_id long, v array<double>, y4 int").repartition(5)


def _slope(value, at, i, h=1e-5):
    step = np.zeros_like(at)
    step[i] = h
    return (value(at + step) - value(at - step)) / (2 * h)


def test_gradient_of_folds(clouds):
    x, y = clouds
    part, weight = np.arange(600) % 5, np.random.default_rng(0).uniform(0.5, 2, (5, 4))
    at = np.random.default_rng(1).normal(size=5 * 4 * 7)
    sums = lambda w: gradients.fold_losses(w.reshape(5, 4, 7), weight)(x, y, part)
    found = sums(at)
    for i in range(0, 140, 9):
        assert np.isclose(found[5 + i], _slope(lambda w: sums(w)[:5].sum(), at, i), atol=1e-3)


def test_gradient_of_the_network(clouds):
    x, y = clouds
    part = (np.arange(600) % 10 == 0).astype(int)
    rng = np.random.default_rng(2)
    at = rng.normal(size=7 * 8 + 9 * 4)

    def sums(w):
        net = gradients.Network(w[:56].reshape(7, 8), w[56:].reshape(9, 4))
        return gradients.network_losses(net)(x, y, part)

    found = sums(at)
    assert found[-3] == 540 and found[-1] == 60
    for i in range(0, len(at), 5):
        assert np.isclose(found[i], _slope(lambda w: sums(w)[-4], at, i), rtol=1e-3, atol=1e-3)


def test_sum_does_not_depend_on_partitions(spark, table):
    partial = lambda x, y, part: np.r_[x.sum(axis=0), y.sum(), part.sum(), len(y)]
    rows = gradients.training_rows(table, "v", "y4", 6, F.lit(1))
    a, b = (gradients.summed(rows.repartition(n), partial, 9) for n in (1, 7))
    assert np.allclose(a, b) and a[-1] == 600


def test_nothing_to_learn_from(table):
    none = table.limit(0)
    net = models.fit_mlp(none, "v", "y4", 6, hidden=3)
    assert {round(p, 6) for r in models.predicted(net, table, "v", "y4").limit(9).collect() for p in r.prob4} == {0.25}
    assert models.out_of_fold(none, "image_id", "v", "y4").count() == 0


def test_fold_models_are_those_of_single_fits(table):
    scored = models.out_of_fold(table, "image_id", "v", "y4")
    assert scored.count() == 600
    one = models.fit_logistic(scored.filter("fold != 2").select("image_id", "v", "y4"), "v", "y4", max_iter=3000)
    held = scored.filter("fold = 2").select("image_id", "v", "y4", F.col("prob4").alias("mine"))
    for r in models.predicted(one, held, "v", "y4").collect():
        assert np.allclose(r.mine, r.prob4, atol=5e-3)


def test_network_stops_by_itself_and_keeps_its_best(table, monkeypatch):
    judged = []
    plain = gradients.summed

    def spied(rows, partial, size):
        out = plain(rows, partial, size)
        judged.append(out[-2] / out[-1])
        return out

    monkeypatch.setattr(gradients, "summed", spied)
    net = models.fit_mlp(table, "v", "y4", 6, hidden=32, max_iter=600)
    assert net.steps == len(judged) < 600
    held = (F.pmod(F.xxhash64("v", "y4"), F.lit(10)) == 0).cast("int")
    rows = gradients.training_rows(table, "v", "y4", 6, held)
    kept = plain(rows, gradients.network_losses(net), net.hidden.size + net.out.size + 4)
    assert kept[-2] / kept[-1] <= min(judged) + 1e-3
    right = models.predicted(net, table, "v", "y4").filter("pred4 = y4").count()
    assert right > 400


def test_rows_that_teach_nothing_leave(spark):
    rows = [(1, [1.0, None], 0), (2, None, 1), (3, [1.0], 1), (4, [1.0, 2.0], None), (5, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "image_id long, v array<double>, y4 int")
    assert gradients.training_rows(df, "v", "y4", 2, F.lit(0)).count() == 1

"""Fits do the work that their definition asks for."""

from pyspark.sql import functions as F

from figureyard.operators import models
from figureyard.plans import registered

FOLDER = "/root/testdata/sf0.001"


def test_fits_have_the_sizes_of_the_definition(spark, monkeypatch):
    asked = {}

    def caught(name):
        def fit(train, vector, *args, **settings):
            asked[name] = settings
            if name.startswith("ml5"):
                settings["features"] = {len(r[0]) for r in train.select(vector).collect()}
            raise InterruptedError

        return fit

    for fit, query in (
        ("fit_logistic", "ml3_logistic_probe"), ("fit_mlp", "ml4_mlp_head"), ("fit_trees", "ml5_boosted_trees")
    ):
        monkeypatch.setattr(models, fit, caught(query))
        try:
            registered.QUERIES[query](spark, FOLDER)
        except InterruptedError:
            pass
    assert asked["ml3_logistic_probe"]["max_iter"] == 3000
    assert asked["ml4_mlp_head"] == {"hidden": 256, "max_iter": 600}
    assert asked["ml5_boosted_trees"] == {"max_iter": 100, "depth": 5, "features": {10}}


def test_cleaned_probe_retrains_on_each_rule(spark):
    rows = registered.QUERIES["ml13_cleaned_probe"](spark, FOLDER).collect()
    assert {r.cleaning for r in rows} == {"none", "conservative", "aggressive"}


def test_boosters_grow_side_by_side_on_dealt_rows(spark, monkeypatch):
    seen = []

    class Caught:
        def __init__(self, classifier, parallelism=1):
            self.parallelism = parallelism

        def fit(self, df):
            seen.append((self.parallelism, [[r.k for r in part] for part in df.rdd.glom().collect()]))

    monkeypatch.setattr(models, "OneVsRest", Caught)
    monkeypatch.setattr(models, "TASK_ROWS", 100)
    rows = spark.range(1000).select(
        F.col("id").alias("k"), F.array(F.col("id") % 7, F.lit(1)).cast("array<double>").alias("v"),
        (F.col("id") % 4).alias("y"),
    )
    for files in (1, 3):
        models.fit_trees(rows.repartition(files), "v", "y", "k")
    (side_by_side, parts), (_, again) = seen
    assert side_by_side == 4 and len(parts) == 10 and parts == again
    assert sorted(k for p in parts for k in p) == list(range(1000)) and max(map(len, parts)) < 200

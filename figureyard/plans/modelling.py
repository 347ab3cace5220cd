"""Fits and scores on the embedding table."""

import numpy as np
from pyspark.sql import functions as F

from figureyard.functions import pixels
from figureyard.functions.columns import class_index
from figureyard.functions.vectors import argmax
from figureyard.operators import datasets, evaluation, models
from figureyard.operators.ranking import seeded_hash
from figureyard.plans.catalog import query
from figureyard.plans.evaluating import two_sides
from figureyard.plans.joining import _CENTROID
from figureyard.schemas import PREDICTIONS
from figureyard.sinks import stores
from figureyard.sources import tables as t
from figureyard.session import materialised, shared_path

DIM = 64
MAX_ITER = 3000  # of logistic probes, which stop at convergence


def labelled(spark, d):
    """Embeddings with a four-way class and a hash split."""
    share = F.conv(F.substring(seeded_hash(datasets.SEED, F.col("vec_id")), 1, 2), 16, 10).cast("int")
    split = F.when(share < 179, "train").when(share < 218, "val").otherwise("test")
    return t.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image_id"), "embedding", (F.col("label") % 4).alias("y4"), split.alias("split")
    )


def _report(scored):
    guess, truth = F.col("pred4") == 0, F.col("y4") == 0
    return evaluation.binary_metrics(scored, truth, guess, ["split"])


@query(
    "ml1_batch_scorer",
    """
    WITH z AS (SELECT vec_id, c, sum(CAST(embedding[j + 1] AS DOUBLE) * (-1 + 2 * (c * 64 + j) / 255::DOUBLE)) AS z
               FROM embeddings, range(0, 64) r(j), range(0, 4) k(c) GROUP BY vec_id, c),
         p AS (SELECT vec_id, c, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM z)
    SELECT vec_id AS image_id, ['diagram', 'data_plot', 'photo', 'fragment_junk'][arg_max(c, p) + 1] AS cls,
           round(max(p) FILTER (c = 0), 4) AS p FROM p GROUP BY vec_id
    """,
)
def batch_scorer(spark, d):
    """Any model can be plugged in; here a linear one with fixed weights."""
    weights = np.linspace(-1.0, 1.0, 4 * DIM).reshape(4, DIM)
    score = models.batch_scorer(models.linear_softmax(weights, np.zeros(4)), DIM)
    e = labelled(spark, d).withColumn("prob", score("embedding"))
    return e.select(
        "image_id", *[c.alias(n) for n, c in models.verdict(F.col("prob")).items()]
    ).withColumn("p", F.round("p", 4))


@query(
    "ml2_zero_shot",
    f"""
    WITH {_CENTROID},
         pr AS (SELECT vec_id, arg_max(label, s) AS pred, max(exp(10 * s)) / sum(exp(10 * s)) AS p FROM sc GROUP BY vec_id)
    SELECT e.label, count(*) AS n, count(*) FILTER (pr.pred = e.label) AS hits, round(avg(p), 3) AS mean_p
    FROM pr JOIN embeddings e ON e.vec_id = pr.vec_id GROUP BY e.label
    """,
)
def zero_shot(spark, d):
    e = t.table(spark, d, "embeddings")
    scored = models.zero_shot(e, "embedding", models.centroids(e, "label", "embedding"), "label")
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("hits"),
        F.round(F.avg(F.array_max("prob")), 3).alias("mean_p"),
    )


@query("ml3_logistic_probe")
def logistic_probe(spark, d):
    e = labelled(spark, d)
    model = models.fit_logistic(e.filter(F.col("split") == "train"), "embedding", "y4", max_iter=MAX_ITER)
    return _report(models.predicted(model, e, "embedding", "y4"))


@query("ml3_deployed_probe")
def deployed_probe(spark, d):
    """The deployed gate trains on every row and is saved for the scorer."""
    e = labelled(spark, d)
    model = models.fit_logistic(e, "embedding", "y4", max_iter=MAX_ITER)
    path = shared_path(spark, "gate-model")
    model.save(path)
    score = models.batch_scorer(
        models.linear_softmax(model.coefficientMatrix.toArray(), model.interceptVector.toArray()), DIM
    )
    scored = e.withColumn("prob4", score("embedding")).withColumn("pred4", argmax(F.col("prob4")))
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("pred4") == F.col("y4")).cast("double")), 4).alias("train_acc"),
    )


@query("ml4_mlp_head")
def mlp_head(spark, d):
    e = labelled(spark, d)
    model = models.fit_mlp(e.filter(F.col("split") == "train"), "embedding", "y4", DIM, hidden=256, max_iter=600)
    return _report(models.predicted(model, e, "embedding", "y4"))


@query("e4_probe_to_report")
def probe_to_report(spark, d):
    """Both heads fitted, their predictions of the splits not learnt from saved as
    prediction sets, read back and reported against silver and gold."""
    e, path = labelled(spark, d), shared_path(spark, "prediction-sets")
    train, rest = e.filter(F.col("split") == "train"), e.filter(F.col("split") != "train")
    heads = {
        "probe_logreg": models.fit_logistic(train, "embedding", "y4", max_iter=MAX_ITER),
        "probe_mlp": models.fit_mlp(train, "embedding", "y4", DIM, hidden=256, max_iter=600),
    }
    for name, model in heads.items():
        stores.save_predictions(
            models.predicted(model, rest, "embedding", "y4").withColumn("name", F.lit(name)), path
        )
    tested = spark.read.schema(PREDICTIONS).parquet(path).filter(F.col("split") == "test")
    found = evaluation.evaluation_report(two_sides(spark, d, tested.select("name", "image_id", "pred4")))
    return found.drop("confusion", "slices")


@query("ml5_boosted_trees")
def boosted_trees(spark, d):
    """Trees on the ten cheap features of crops; one without pixels has none."""
    images = t.images(spark, d)
    crops = datasets.silver_crops(images, F.lit(""))
    blobs = t.table(spark, d, "documents").where(F.col("n_chars") > 0).select(
        F.col("doc_id").alias("image_id"),
        pixels.pixel_stats(F.encode("text", "UTF-8"), F.lit(64)).alias("px"),
    )
    found = pixels.crop_features(F.col("file_bytes"), F.col("width"), F.col("height"), F.col("px"))
    shape = images.select("image_id", "file_bytes", "width", "height").join(blobs, "image_id").select(
        "image_id", F.array(*[c.cast("double") for c in found.values()]).alias("shape")
    )
    share = F.conv(F.substring(seeded_hash(datasets.SEED, F.col("image_id")), 1, 2), 16, 10).cast("int")
    rows = crops.join(shape, "image_id").select(
        "image_id", "shape", class_index(F.col("cls")).alias("y4"),
        F.when(share < 179, "train").otherwise("test").alias("split"),
    )
    # each booster reads them in every round
    rows = materialised(rows, "crop-shapes")
    model = models.fit_trees(rows.filter(F.col("split") == "train"), "shape", "y4", "image_id", max_iter=100, depth=5)
    return _report(models.predicted(model, rows, "shape", "y4"))


@query("ml13_label_cleaning")
def label_cleaning(spark, d):
    """Share of labels each cleaning rule drops, from out-of-fold models."""
    e = labelled(spark, d).withColumn(
        "noisy4", F.when(F.col("image_id") % 9 == 0, (F.col("y4") + 1) % 4).otherwise(F.col("y4"))
    )
    scored = models.out_of_fold(e, "image_id", "embedding", "noisy4")
    parts = []
    for name, confident in (("conservative", True), ("aggressive", False)):
        marked = models.label_issues(scored, "noisy4", "prob4", confident)
        parts.append(
            marked.agg(
                F.count(F.lit(1)).alias("n"), F.count_if("issue").alias("dropped"),
                F.count_if(F.col("issue") & (F.col("noisy4") != F.col("y4"))).alias("true_errors"),
            ).withColumn("rule", F.lit(name))
        )
    return parts[0].unionByName(parts[1])


@query("ml13_cleaned_probe")
def cleaned_probe(spark, d):
    """Accuracy after retraining on cleaned labels, against the true classes."""
    e = labelled(spark, d).withColumn(
        "noisy4", F.when(F.col("image_id") % 9 == 0, (F.col("y4") + 1) % 4).otherwise(F.col("y4"))
    )
    train, rest = e.filter(F.col("split") == "train"), e.filter(F.col("split") != "train")
    scored = models.out_of_fold(train, "image_id", "embedding", "noisy4")
    rounds = [("none", train)]
    for rule, confident in (("conservative", True), ("aggressive", False)):
        kept = models.label_issues(scored, "noisy4", "prob4", confident).filter(~F.col("issue"))
        rounds.append((rule, materialised(kept.select(train.columns), f"kept-labels-{rule}")))
    parts = []
    for name, rows in rounds:
        model = models.fit_logistic(rows, "embedding", "noisy4", max_iter=MAX_ITER)
        out = _report(models.predicted(model, rest, "embedding", "noisy4"))
        parts.append(out.withColumn("cleaning", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "ml15_normalised_cache",
    """
    SELECT vec_id AS image_id, round(list_extract(CAST(embedding AS DOUBLE[]), 1) / n, 4) AS first, CAST(len(embedding) AS INT) AS dim
    FROM (SELECT *, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)
    """,
)
def normalised_cache(spark, d):
    path = shared_path(spark, "embedding-cache")
    e = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")
    stores.cache_embeddings(e, path, "encoder")
    return spark.read.parquet(path).select(
        "image_id", F.round(F.get("embedding", 0).cast("double"), 4).alias("first"),
        F.size("embedding").alias("dim"),
    )

"""Batch scoring, zero-shot scoring and model fitting on embeddings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figureyard.functions.columns import hash_int
from figureyard.functions.vectors import argmax, dot, norm, softmax_scores, unit_vector
from figureyard.operators import gradients
from figureyard.operators.datasets import class_weights
from figureyard.schemas import CLASSES
from figureyard.session import materialised

FOLDS = 5
TASK_ROWS = 32768  # rows that a pass of boosting leaves to one task


def batch_scorer(make_predict: Callable[[], Callable], dim: int,
                 batch_size: int = 32) -> Callable[[Column], Column]:
    """A pluggable scorer: ``make_predict`` loads the model once per worker and
    returns a function from a batch of vectors to class probabilities."""
    return predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
        input_tensor_shapes=[[dim]],
    )


def verdict(prob: Column, classes: Sequence[str] = CLASSES) -> dict[str, Column]:
    names = F.array(*[F.lit(c) for c in classes])
    return {"cls": F.get(names, argmax(prob)), "p": F.get(prob, 0)}


def linear_softmax(weights: np.ndarray, bias: np.ndarray) -> Callable[[], Callable]:
    """Model factory for ``batch_scorer`` from linear weights."""
    def make() -> Callable:
        def predict(x: np.ndarray) -> np.ndarray:
            z = x.astype(np.float64) @ weights.T + bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)
        return predict
    return make


def aligned(manifest: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Manifest rows that have an embedding."""
    return manifest.join(embeddings, "image_id")


def centroids(vectors: DataFrame, cls: str, vector: str) -> DataFrame:
    """Normalised mean of normalised vectors per class. Every task adds up its
    own vectors before the shuffle, so a class never meets in one task."""
    means = vectors.select(cls, array_to_vector(unit_vector(vector)).alias("v")).groupBy(cls).agg(
        vector_to_array(Summarizer.mean(F.col("v"))).alias("c")
    )
    length = norm(F.col("c"))
    return means.select(
        cls, F.transform("c", lambda x: x / F.when(length == 0, 1.0).otherwise(length)).alias("centroid")
    )


def zero_shot(vectors: DataFrame, vector: str, table: DataFrame, cls: str) -> DataFrame:
    """Cosine scores against class centroids, their softmax and the best class.
    The centroid list has one entry per class and rides along as a scalar."""
    listed = table.agg(
        F.array_sort(F.collect_list(F.struct(F.col(cls).alias("cls"), "centroid"))).alias("all")
    ).scalar()
    return (
        vectors.withColumn("__c", listed)
        .withColumn("__n", norm(F.col(vector)))
        .withColumn(
            "scores",
            F.transform(
                F.col("__c"),
                lambda c: dot(F.col(vector), c["centroid"])
                / F.when(F.col("__n") == 0, 1.0).otherwise(F.col("__n")),
            ),
        )
        .withColumn("pred", F.get(F.col("__c"), argmax(F.col("scores")))["cls"])
        .withColumn("prob", softmax_scores(F.col("scores")))
        .drop("__c", "__n")
    )


def _features(df: DataFrame, vector: str, y: str) -> DataFrame:
    return df.withColumns(
        {"features": array_to_vector(F.col(vector)), "label": F.col(y).cast("double")}
    )


def fit_logistic(train: DataFrame, vector: str, y: str, c: float = 1.0,
                 max_iter: int = 100, k: int = len(CLASSES)):
    """Multinomial logistic probe with balanced class weights.

    The usual objective sums weighted losses plus ``|w|^2 / 2C``; MLlib averages
    them, hence ``regParam = 1 / (C * sum of weights)``, and balanced weights
    sum to the number of rows.
    """
    weights = class_weights(train, y, k).select(y, F.col("balanced").alias("weight"))
    data = _features(train.join(F.broadcast(weights), y), vector, y)
    n = max(train.count(), 1)
    model = LogisticRegression(
        family="multinomial", weightCol="weight", regParam=1.0 / (c * n),
        elasticNetParam=0.0, standardization=False, maxIter=max_iter,
    )
    return model.fit(data)


def fit_mlp(train: DataFrame, vector: str, y: str, dim: int, hidden: int = 256,
            max_iter: int = 600, k: int = len(CLASSES)) -> gradients.Network:
    """One hidden layer, stopped early by a tenth of the rows that it doesn't learn
    from; which ones follows from their content."""
    held = (F.pmod(F.xxhash64(vector, y), F.lit(10)) == 0).cast("int")
    rows = gradients.training_rows(train, vector, y, dim, held)
    return gradients.fit_network(rows, dim, hidden, k, max_iter)


def fit_trees(train: DataFrame, vector: str, y: str, key: str, max_iter: int = 10, depth: int = 4,
              k: int = len(CLASSES)):
    """Boosted trees for several classes as one binary booster per class; leaves
    of 20 rows, 255 bins and steps of 0.1 are those of histogram boosting.

    A booster passes over all rows for each level of each tree, so the boosters grow side
    by side. Rows are dealt by ``key``, which is unique, to tasks of about ``TASK_ROWS``:
    narrow rows would come as few file splits. Over 65,025 rows MLlib draws its candidate
    splits from a sample by place, which now depends neither on the files nor on the cores.
    """
    booster = GBTClassifier(
        maxIter=max_iter, maxDepth=depth, seed=0, minInstancesPerNode=20, maxBins=255, stepSize=0.1
    )
    rows = train.select(key, vector, y)
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    dealt = rows.repartition(tasks, key).sortWithinPartitions(key)
    return OneVsRest(classifier=booster, parallelism=k).fit(_features(dealt, vector, y))


def predicted(model, df: DataFrame, vector: str, y: str) -> DataFrame:
    if isinstance(model, gradients.Network):
        score = batch_scorer(model.factory(), model.dim, 1024)
        return df.withColumn("prob4", score(vector)).withColumn("pred4", argmax(F.col("prob4")))
    out = model.transform(_features(df, vector, y))
    out = out.withColumn("pred4", F.col("prediction").cast("int"))
    if "probability" in out.columns:
        out = out.withColumn("prob4", vector_to_array("probability"))
    drop = ["features", "label", "rawPrediction", "probability", "prediction"]
    return out.drop(*[c for c in drop if c in out.columns])


def out_of_fold(df: DataFrame, key: str, vector: str, y: str, max_iter: int = 3000,
                dim: int | None = None, k: int = len(CLASSES)) -> DataFrame:
    """Probabilities for every row with a whole vector from a model that never saw
    it. The models of all folds learn in the same passes, to convergence."""
    if dim is None:
        dim = df.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]
    whole = (F.size(vector) == dim) & F.forall(vector, lambda v: v.isNotNull())
    fold = F.coalesce(F.pmod(hash_int(F.col(key).cast("string")), F.lit(FOLDS)), F.lit(0))
    folded = df.filter(whole).withColumn("fold", fold)
    rows = gradients.training_rows(folded, vector, y, dim, F.col("fold"))
    fitted = gradients.fit_folds(rows, FOLDS, k, dim, 1.0, max_iter)
    scored = gradients.fold_scores(folded, vector, "fold", fitted, "prob4")
    return materialised(scored.withColumn("pred4", argmax(F.col("prob4"))), "out-of-fold")


def label_issues(scored: DataFrame, y: str, prob: str, confident: bool) -> DataFrame:
    """Mark rows whose label confidently disagrees with the model.

    A class is confident from its mean self-confidence up. The confident rule
    drops rows that reach another class's threshold; the wider rule drops every
    row whose most likely class differs from its label.
    """
    own = F.get(prob, F.col(y).cast("int"))
    means = scored.groupBy(F.col(y).alias("c")).agg(F.avg(own).alias("t"))
    limits = means.agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("int"), "t")))
    ).scalar()
    best = argmax(F.col(prob))
    differs = best != F.col(y)
    sure = F.coalesce(F.get(prob, best) >= F.try_element_at(limits, best), F.lit(False))
    return scored.withColumn("issue", differs & sure if confident else differs)

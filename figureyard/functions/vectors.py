"""Dense vector helpers, all of them array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit_vector(vector: Column | str) -> Column:
    """L2-normalised vector (doubles); a zero vector stays zero. The length is
    bound once: inside the lambda over elements it would be taken for each."""
    v = F.col(vector) if isinstance(vector, str) else vector

    def scaled(length: Column) -> Column:
        return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length))

    return F.get(F.transform(F.array(norm(v)), scaled), F.lit(0))


def softmax_scores(scores: Column, temperature: float = 10.0) -> Column:
    """Shares of ``exp(temperature * score)``."""
    raised = F.transform(scores, lambda s: F.exp(F.lit(temperature) * s))
    total = F.aggregate(raised, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(raised, lambda x: x / total)


def argmax(scores: Column) -> Column:
    """Zero-based position of the largest value; the first one wins ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")

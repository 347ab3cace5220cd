"""Models fitted on gradients that Spark sums.

A step sends the parameters to the tasks; every task gives one vector, its part of
losses and gradients, and the JVM adds these up. The driver holds parameters and a
few vectors as long, never rows. A lost executor costs the parts of its tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figureyard.session import materialised

# x (rows, dim), y (rows,), part (rows,) -> one vector
Partial = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
TOLERANCE = 1e-6  # of the largest entry of a gradient of mean losses


def training_rows(df: DataFrame, vector: str, y: str, dim: int, part) -> DataFrame:
    """Written rows (x, y, part). A row without a class, without a vector or with
    one of another length or holes teaches nothing and leaves."""
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = (F.size(vector) == dim) & F.forall(vector, lambda v: v.isNotNull()) & F.col(y).isNotNull()
    rows = df.filter(whole).select(x.alias("x"), F.col(y).cast("int").alias("y"), part.cast("int").alias("part"))
    return materialised(rows, "training-rows")


def summed(rows: DataFrame, partial: Partial, size: int) -> np.ndarray:
    """Sum of ``partial`` over all rows, of which there has to be one: ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                total += partial(x, b.column("y").to_numpy(), b.column("part").to_numpy())
        yield pa.record_batch({"v": pa.array([total.tolist()])})

    parts = rows.mapInArrow(run, "v array<double>")
    found = parts.agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).first()
    return np.asarray(found["v"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def descend(
    value: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, max_iter: int,
    memory: int = 10,
) -> np.ndarray:
    """Least point of a smooth convex function by limited-memory quasi-Newton steps
    and halving."""
    f, g = value(at)
    past: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=memory)
    for _ in range(max_iter):
        if np.abs(g).max() <= TOLERANCE:
            break
        way, factors = g.copy(), []
        for s, t in reversed(past):
            factors.append(s @ way / (s @ t))
            way -= factors[-1] * t
        if past:
            s, t = past[-1]
            way *= (s @ t) / (t @ t)
        for (s, t), a in zip(past, reversed(factors)):
            way += (a - t @ way / (s @ t)) * s
        step = 1.0 if past else min(1.0, 1.0 / np.linalg.norm(g))
        while True:
            new = at - step * way
            f_new, g_new = value(new)
            if f_new <= f - 1e-4 * step * (way @ g):
                break
            step /= 2
            if step < 1e-10:  # as near as doubles come
                return at
        if (new - at) @ (g_new - g) > 0:
            past.append((new - at, g_new - g))
        at, f, g = new, f_new, g_new
    return at


def fold_losses(w: np.ndarray, weight: np.ndarray) -> Partial:
    """Losses and gradients of a softmax model for each fold over the rows outside
    it. ``w``: folds x classes x (dim + 1); ``weight``: folds x classes."""
    folds, k, wide = w.shape

    def partial(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> np.ndarray:
        one = np.hstack([x, np.ones((len(x), 1))])
        p = softmax((one @ w.reshape(-1, wide).T).reshape(-1, folds, k))
        pull = weight[:, y].T * (part[:, None] != np.arange(folds))
        at = np.arange(len(y))
        loss = -(pull * np.log(np.maximum(p[at, :, y], 1e-300))).sum(axis=0)
        p[at, :, y] -= 1.0
        grad = (p * pull[:, :, None]).reshape(len(y), -1).T @ one
        return np.concatenate([loss, grad.ravel()])

    return partial


def fit_folds(rows: DataFrame, folds: int, k: int, dim: int, c: float, max_iter: int) -> np.ndarray:
    """Balanced logistic models, one for each fold from the rows of the others, all
    of them in the same passes: folds x classes x (dim + 1). Without any rows all
    classes are as likely."""
    counts = np.zeros((folds, k))
    for r in rows.groupBy("part", "y").count().collect():  # folds x classes rows
        counts[r["part"], r["y"]] = r["count"]
    if not counts.any():
        return np.zeros((folds, k, dim + 1))
    outside = counts.sum(axis=0) - counts
    n = np.maximum(outside.sum(axis=1), 1.0)
    weight = n[:, None] / (k * np.maximum(outside, 1.0))

    def value(flat: np.ndarray) -> tuple[float, np.ndarray]:
        w = flat.reshape(folds, k, dim + 1)
        found = summed(rows, fold_losses(w, weight), folds + w.size)
        slopes = w.copy()
        slopes[:, :, -1] = 0.0
        loss = found[:folds] + (slopes**2).sum(axis=(1, 2)) / (2 * c)
        grad = found[folds:].reshape(w.shape) + slopes / c
        return float((loss / n).sum()), (grad / n[:, None, None]).ravel()

    return descend(value, np.zeros(folds * k * (dim + 1)), max_iter).reshape(folds, k, dim + 1)


def fold_scores(df: DataFrame, vector: str, fold: str, models: np.ndarray, name: str) -> DataFrame:
    """``df`` with the probabilities that the model of a row's fold gives it."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(x: pd.Series, f: pd.Series) -> pd.Series:
        one = np.hstack([np.stack(x.to_numpy()), np.ones((len(x), 1))])
        z = np.einsum("nd,nkd->nk", one, models[f.to_numpy().astype(int)])
        return pd.Series(softmax(z).tolist())

    return df.withColumn(name, score(vector, fold))


@dataclass(frozen=True)
class Network:
    """One hidden layer of rectified units and a softmax, as matrices whose last row
    is the bias."""

    hidden: np.ndarray
    out: np.ndarray
    steps: int = 0

    @property
    def dim(self) -> int:
        return len(self.hidden) - 1

    def factory(self) -> Callable[[], Callable]:
        def make() -> Callable:
            return lambda x: self.forward(np.asarray(x, np.float64))[1]

        return make

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.hidden[:-1] + self.hidden[-1], 0.0)
        return h, softmax(h @ self.out[:-1] + self.out[-1])


def network_losses(net: Network) -> Partial:
    """Over the rows of part 0 the gradient, loss and count, of part 1 loss and count."""

    def partial(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> np.ndarray:
        h, p = net.forward(x)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))
        learn = part == 0
        p[np.arange(len(y)), y] -= 1.0
        p *= learn[:, None]
        back = (p @ net.out[:-1].T) * (h > 0)
        grads = [np.vstack([x.T @ back, back.sum(axis=0)]), np.vstack([h.T @ p, p.sum(axis=0)])]
        told = [loss[learn].sum(), learn.sum(), loss[~learn].sum(), (~learn).sum()]
        return np.concatenate([*(g.ravel() for g in grads), told])

    return partial


def fit_network(
    rows: DataFrame, dim: int, hidden: int, k: int, max_iter: int, patience: int = 10,
    rate: float = 0.01, decay: float = 1e-4, seed: int = 0,
) -> Network:
    """Adaptive-moment steps on the rows of part 0 until the mean loss of part 1 has
    not fallen by 1e-4 for ``patience`` steps; the best weights are kept. Without
    rows of part 1 the training loss decides, without any all classes are as likely."""
    if rows.isEmpty():
        return Network(np.zeros((dim + 1, hidden)), np.zeros((hidden + 1, k)))
    rng = np.random.default_rng(seed)

    def layer(a: int, b: int) -> np.ndarray:
        bound = np.sqrt(6.0 / (a + b))
        return rng.uniform(-bound, bound, (a + 1, b))

    first, second = layer(dim, hidden), layer(hidden, k)
    flat, cut = np.concatenate([first.ravel(), second.ravel()]), first.size

    def shaped(v: np.ndarray, steps: int = 0) -> Network:
        return Network(v[:cut].reshape(first.shape), v[cut:].reshape(second.shape), steps)

    # weights decay, biases do not
    slopes = np.concatenate([np.r_[np.ones(m.size - m.shape[1]), np.zeros(m.shape[1])] for m in (first, second)])
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    best, best_loss, since = flat, np.inf, 0
    for step in range(1, max_iter + 1):
        found = summed(rows, network_losses(shaped(flat)), flat.size + 4)
        grad, (loss, n, held_loss, held) = found[:-4], found[-4:]
        judged = held_loss / held if held else loss / max(n, 1)
        if judged < best_loss - 1e-4:
            best, best_loss, since = flat, judged, 0
        else:
            since += 1
            if since >= patience:
                break
        g = (grad + decay * flat * slopes) / max(n, 1)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        flat = flat - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return shaped(best, step)

"""Language of every byte and document by a bidirectional gated recurrent network.

A gated recurrent unit reads the bytes of a window forwards, another backwards;
a linear layer over both states gives each position its language probabilities.
A document's probabilities are the mean over all its positions. The network is
trained here, in numpy, by backpropagation through time.

Fitting uses a bounded sample: about ``Sample.documents`` documents of each of
the ``Sample.languages`` most frequent languages, chosen by hash among those with
a language and outside the held-out quarter, ``Sample.windows`` windows of
each at hashed places. Labelling covers every byte of every text: texts are cut
into windows of ``WINDOW`` bytes, which run side by side.

A null text or one without a letter is ``und`` with score 0. Without any
labelled document all are ``und``. A null doc_id is neither held out nor learned
from. Repeated rows get the same answer; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figureyard.llm.common import table

WINDOW = 128
TOGETHER = 1024  # windows that run side by side
PAD = 256
UNKNOWN = "und"


@dataclass(frozen=True)
class Sample:
    languages: int = 64
    documents: int = 1500  # of each language
    windows: int = 4  # of each document
    bytes: int = 64  # of each window


@dataclass(frozen=True)
class Fit:
    hidden: int = 6
    steps: int = 400
    batch: int = 192
    rate: float = 0.015
    seed: int = 11


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_network(hidden: int, languages: int, seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    net = {}
    for d in "fb":
        # rows are bytes; the last, for padding, keeps the state as it is
        net["in" + d] = (r.standard_normal((257, 3 * hidden)) * 0.3).astype(np.float32)
        net["re" + d] = (r.standard_normal((hidden, 3 * hidden)) / hidden**0.5).astype(np.float32)
        net["out" + d] = (r.standard_normal((hidden, languages)) * 0.1).astype(np.float32)
    net["bias"] = np.zeros(languages, np.float32)
    return net


def closed_gate(net: dict[str, np.ndarray]) -> None:
    """Padding sets the update gate to one, so that it passes the state on."""
    for d in "fb":
        h = net["re" + d].shape[0]
        net["in" + d][PAD] = 0
        net["in" + d][PAD, :h] = 40


def states(net: dict, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (time, window, unit) in direction ``d`` and what the way
    back needs. ``x``: bytes (time, window)."""
    into, re = net["in" + d], net["re" + d]
    hidden = re.shape[0]
    order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
    h = np.zeros((x.shape[1], hidden), np.float32)
    out, kept = np.empty((len(x), x.shape[1], hidden), np.float32), []
    for t in order:
        a, g = into[x[t]], h @ re
        gates = sigmoid(a[:, : 2 * hidden] + g[:, : 2 * hidden])
        z, r = gates[:, :hidden], gates[:, hidden:]
        c = np.tanh(a[:, 2 * hidden :] + r * g[:, 2 * hidden :])
        kept.append((t, h, z, r, c, g[:, 2 * hidden :]))
        h = c + z * (h - c)
        out[t] = h
    return out, kept


def probabilities(net: dict, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
    y = hf @ net["outf"] + hb @ net["outb"] + net["bias"]
    y -= y.max(-1, keepdims=True)
    np.exp(y, out=y)
    return y / y.sum(-1, keepdims=True)


def gradients(net: dict, x: np.ndarray, label: np.ndarray) -> tuple[dict, float]:
    """Of the mean cross-entropy over all positions, by going back in time."""
    (hf, kf), (hb, kb) = states(net, "f", x), states(net, "b", x)
    p = probabilities(net, hf, hb)
    real = (x != PAD)[..., None]
    n, many = max(1, int(real.sum())), np.arange(x.shape[1])
    loss = -float((np.log(p[:, many, label] + 1e-9) * real[..., 0]).sum()) / n
    dy = p.copy()
    dy[:, many, label] -= 1
    dy *= real / n
    grad = {"bias": dy.sum((0, 1))}
    for d, hs, kept in (("f", hf, kf), ("b", hb, kb)):
        re, out = net["re" + d], net["out" + d]
        hidden = re.shape[0]
        grad["out" + d] = np.tensordot(hs, dy, ((0, 1), (0, 1)))
        dh_all, dre = dy @ out.T, np.zeros_like(re)
        da_all = np.empty((*x.shape, 3 * hidden), np.float32)
        later = np.zeros_like(dh_all[0])
        for t, before, z, r, c, gc in reversed(kept):
            dh = dh_all[t] + later
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * gc * r * (1 - r)
            da = np.concatenate([dz, dr, dc], 1)
            dg = np.concatenate([dz, dr, dc * r], 1)
            da_all[t] = da
            dre += before.T @ dg
            later = dh * z + dg @ re.T
        grad["re" + d] = dre
        grad["in" + d] = np.zeros_like(net["in" + d])
        np.add.at(grad["in" + d], x.ravel(), da_all.reshape(-1, 3 * hidden))
        grad["in" + d][PAD] = 0
    return grad, loss


def train(windows: np.ndarray, labels: np.ndarray, languages: int, fit: Fit = Fit()) -> dict:
    """Network fitted by Adam on (window, byte) rows with a label each; every
    language is drawn equally often."""
    r = np.random.default_rng(fit.seed)
    net = new_network(fit.hidden, languages, fit.seed)
    closed_gate(net)
    mean = {k: np.zeros_like(v) for k, v in net.items()}
    square = {k: np.zeros_like(v) for k, v in net.items()}
    places = [np.flatnonzero(labels == k) for k in range(languages)]
    for step in range(1, fit.steps + 1):
        kinds = r.integers(0, languages, fit.batch)
        chosen = np.array([places[k][r.integers(len(places[k]))] for k in kinds])
        grad, _ = gradients(net, windows[chosen].T.astype(np.int64), labels[chosen])
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = fit.rate * (1 - 0.9 * step / fit.steps)
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (size + 1e-9))
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            net[k] -= rate * (mean[k] / (1 - 0.9**step)) / (
                np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6
            )
        closed_gate(net)
    return net


def run_direction(net: dict, d: str, x: np.ndarray) -> np.ndarray:
    """``states`` for labelling only: gates' inputs come halved, buffers are used again."""
    into, re = net["in" + d], net["re" + d]
    hidden, two = re.shape[0], 2 * re.shape[0]
    order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
    h = np.zeros((x.shape[1], hidden), np.float32)
    out = np.empty((len(x), x.shape[1], hidden), np.float32)
    g, a = np.empty((x.shape[1], 3 * hidden), np.float32), np.empty((x.shape[1], 3 * hidden), np.float32)
    gates = np.empty((x.shape[1], two), np.float32)
    for t in order:
        np.take(into, x[t], 0, out=a, mode="clip")
        np.matmul(h, re, out=g)
        np.add(a[:, :two], g[:, :two], out=gates)
        np.tanh(gates, out=gates)
        gates += 1  # twice the gates
        gates *= 0.5
        c = g[:, two:]
        c *= gates[:, hidden:]
        c += a[:, two:]
        np.tanh(c, out=c)
        h -= c
        h *= gates[:, :hidden]
        h += c
        out[t] = h
    return out


def halved(net: dict) -> dict:
    """The gates' weights halved, as a sigmoid is a tanh of half its input."""
    out = {k: v.copy() for k, v in net.items()}
    for d in "fb":
        two = 2 * net["re" + d].shape[0]
        out["in" + d][:, :two] *= 0.5
        out["re" + d][:, :two] *= 0.5
    return out


def pooled(net: dict, texts: list[bytes], languages: int) -> np.ndarray:
    """Mean probabilities over all positions of each text; ``net`` is halved."""
    starts = [len(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [-(-n // WINDOW) for n in starts])
    rows = np.full((len(owner), WINDOW), PAD, np.int64)
    at = 0
    for t in texts:
        n = -(-len(t) // WINDOW)
        rows[at : at + n].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
        at += n
    sums = np.zeros((len(texts), languages))
    for i in range(0, len(rows), TOGETHER):
        x = np.ascontiguousarray(rows[i : i + TOGETHER].T)
        p = probabilities(net, run_direction(net, "f", x), run_direction(net, "b", x))
        p *= (x != PAD)[..., None]
        np.add.at(sums, owner[i : i + TOGETHER], p.sum(0))
    return sums / np.maximum(1, np.array(starts))[:, None]


def sampled_windows(docs: DataFrame, sample: Sample) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows and labels of the bounded training sample."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = (
        known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample.languages)
        .collect()
    )
    names = sorted(r["lang"] for r in counts)
    if not names:
        return [], np.empty((0, sample.bytes), np.int64), np.empty(0, np.int64)
    parts = 1 << 24
    rate = F.create_map(
        *[F.lit(v) for r in counts
          for v in (r["lang"], min(parts, parts * sample.documents // r["count"] + 1))]
    )
    picked = known.where(
        F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(parts)) < F.get(F.array(rate[F.col("lang")]), F.lit(0))
    )
    width, many = sample.bytes, sample.windows
    schema = pa.schema([("lang", pa.string()), ("w", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, out = [], []
            for i, lang, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
                data = (text or "").encode("utf-8", "surrogatepass")
                if not data:
                    continue
                r = np.random.default_rng(abs(i))
                for s in r.integers(0, max(1, len(data) - width + 1), many):
                    langs.append(lang)
                    out.append(data[s : s + width])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], schema=schema)

    # bounded by languages x documents x windows
    rows = sorted((r["lang"], bytes(r["w"])) for r in
                  picked.select("doc_id", "lang", "text").mapInArrow(cut, "lang string, w binary").collect())
    names = sorted({lang for lang, _ in rows})
    windows = np.full((len(rows), width), PAD, np.int64)
    for k, (_, w) in enumerate(rows):
        windows[k, : len(w)] = np.frombuffer(w, np.uint8)
    return names, windows, np.array([names.index(lang) for lang, _ in rows], np.int64)


def predicted(docs: DataFrame, sample: Sample = Sample(), fit: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    docs = docs.select("doc_id", "text", "lang")
    names, windows, labels = sampled_windows(docs, sample)
    net = halved(train(windows, labels, len(names), fit)) if names else {}
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                texts = part.column("text").to_pylist()
                clear = [bool(names) and any(map(str.isalpha, t or "")) for t in texts]
                data = [t.encode("utf-8", "surrogatepass") if c else b"" for t, c in zip(texts, clear)]
                p = pooled(net, data, len(names)) if any(clear) else np.zeros((len(texts), 1))
                best = p.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()),
                     pa.array([names[k] if c else UNKNOWN for k, c in zip(best, clear)]),
                     pa.array([min(1.0, float(v)) if c else 0.0 for v, c in zip(p.max(1), clear)])],
                    schema=schema,
                )

    found = docs.select("doc_id", "text").mapInArrow(label, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def query(spark, folder: str) -> DataFrame:
    return predicted(table(spark, folder, "documents"))

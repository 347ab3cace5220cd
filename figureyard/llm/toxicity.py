"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens get the log-odds of toxic against other labelled documents with an
informative Dirichlet prior whose weights follow the whole corpus. Beginnings of
tokens count as tokens of their own (marked by ``*``), for languages that
compound. A token scores by itself or else by its longest beginning whose
log-odds stand out; every other token costs a fixed drift. A linear scan (all maximal scoring subsequences) then finds every passage
that scores highest among its neighbours. The score of a passage is calibrated by
extreme-value statistics: with m tokens without a real passage, the best one
exceeds S about K m exp(-lambda S) times. The evidence of all significant
passages of a document together is turned into a probability by a logistic curve.

Labels come from a bounded sample: about ``Settings.sample`` documents of each
class, by hash, outside the held-out quarter. Prior counts come from every text
of the corpus, scores from every whole text.

A null or empty text has no passage and gets the score of no evidence. Without
toxic and other labels every score is 0. A null doc_id has no label and is not
held out. Repeated rows score alike; a doc_id with both labels counts as toxic.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figureyard.llm.common import coded_words, slices, table
from figureyard.llm.language import held_out

# ASCII marks and white space part tokens; other bytes belong to them.
MARK, BEGINNINGS = b"*", range(5, 10)  # bytes of a beginning
PARTED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    sample: int = 2500  # labelled documents of each class
    vocabulary: int = 50_000  # tokens that may score for themselves
    prior: float = 1.5  # strength of the corpus prior, in toxic documents of the sample
    stands_out: float = 2.5  # standard errors of the log-odds
    drift: float = 0.1  # cost of any other token
    highest: float = 6.0  # score of a token at most
    significant: float = 0.05  # expected number of chance passages, at most
    threshold: float = 0.3  # of the score, to predict toxic


def parted(text: str | None) -> bytes:
    """The tokens of ``text`` with spaces between them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(PARTED)


def features(words: pa.Array) -> list[pa.Array]:
    """The words themselves and then their beginnings, longest first; null where a
    word is no longer than that."""
    size, mark, nothing = pc.binary_length(words), pa.scalar(MARK, pa.binary()), pa.scalar(b"", pa.binary())
    return [words] + [
        pc.if_else(pc.greater(size, n), pc.binary_join_element_wise(pc.binary_slice(words, 0, n), mark, nothing), None)
        for n in reversed(BEGINNINGS)
    ]


def places(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """For each of ``features`` a row of places in ``vocabulary``, -1 for none."""
    found = pc.index_in(pa.concat_arrays(features(words)), vocabulary)
    return found.fill_null(-1).to_numpy().reshape(1 + len(BEGINNINGS), -1)


def passages(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences (start, end, score), in linear time.

    Candidates keep the sums before and after them. A new one joins the nearest
    earlier candidate with a smaller sum before it, if its own sum after is
    larger; links to that candidate skip those in between.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[list] = []  # start, end, sum before, sum after, nearest smaller
    for k in up.tolist():
        new = [k, k + 1, float(total[k]), float(total[k + 1]), -1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            new[4] = j
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                break
            new[0], new[2] = held[j][0], held[j][2]
            del held[j:]
    return [(s, e, after - before) for s, e, before, after, _ in held]


@dataclass(frozen=True)
class Model:
    scores: dict[bytes, float]
    decay: float  # lambda
    scale: float  # K
    offset: float  # of the logistic curve
    slope: float
    settings: Settings = Settings()

    def token_scores(self, words: pa.Array) -> np.ndarray:
        """Of each word: its own score, else that of its longest beginning that has
        one, else the drift."""
        values = np.array([*self.scores.values(), -self.settings.drift])
        out = np.full(len(words), -self.settings.drift)
        for place in places(words, pa.array(list(self.scores), pa.binary()))[::-1]:
            out = np.where(place >= 0, values[place], out)
        return out

    def significant(self, n: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """(start, end, -log of the expected chance passages) of the passages of ``n``
        tokens that chance seldom makes."""
        if not found:
            return []
        least, chance = -math.log(self.settings.significant), math.log(self.scale * n)
        judged = [(s, e, self.decay * v - chance) for s, e, v in found]
        return [x for x in judged if x[2] >= least]

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        total = 0.0
        for _, _, e in self.significant(n, found):
            total += e
        return total

    def probability(self, evidence: float) -> float:
        if not self.scores:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * evidence))))


def labelled(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """text and toxic of the bounded sample."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in known.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    parts = 1 << 24
    rate = F.when(F.lit(False), 0)
    for kind in (0, 1):
        rate = rate.when(F.col("toxic") == kind, min(parts, parts * settings.sample // max(1, counts.get(kind, 0)) + 1))
    picked = known.where(F.pmod(F.xxhash64(F.lit("label"), "doc_id"), F.lit(parts)) < rate)
    # about two times ``sample`` ids
    return docs.join(F.broadcast(picked), "doc_id").select("text", "toxic")


def document_counts(docs: DataFrame, words: list[bytes]) -> tuple[int, Counter]:
    """Documents of the corpus, and how many hold each of ``words``."""
    schema = pa.schema([("w", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(words, pa.binary())
        seen, docs_seen = np.zeros(len(words) + 1, np.int64), 0  # the last one: not in the vocabulary
        for b in batches:
            docs_seen += b.num_rows
            for cut in slices(b):
                distinct, texts = coded_words([parted(t) for t in cut.column("text").to_pylist()])
                held = places(distinct, vocabulary).T.copy()
                for text in texts:
                    seen[held[text]] += 1  # once, however often a place is listed
        at = np.flatnonzero(seen[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([b"", *(words[i] for i in at)], pa.binary()), pa.array([docs_seen, *seen[at].tolist()], pa.int64())],
            schema=schema,
        )

    rows = (
        docs.select("text").mapInArrow(count, "w binary, n long")
        .groupBy("w").agg(F.sum("n").alias("n")).collect()
    )  # fmt: skip  # at most ``vocabulary`` + 1 rows
    found = Counter({bytes(r["w"]): r["n"] for r in rows})
    return found.pop(b"", 0), found


def sample_counts(distinct: pa.Array, texts: list[np.ndarray], toxic: list[int]) -> pa.Table:
    """How many other and toxic texts hold each feature."""
    coded = pa.concat_arrays(features(distinct)).dictionary_encode()
    none = len(coded.dictionary)
    held = coded.indices.fill_null(none).to_numpy().reshape(1 + len(BEGINNINGS), -1).T.copy()
    seen = np.zeros((2, none + 1), np.int64)
    for text, kind in zip(texts, toxic):
        seen[kind, held[text]] += 1
    return pa.table({"feature": coded.dictionary, "other": seen[0, :none], "toxic": seen[1, :none]})


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Offset and slope by Newton steps with a weak prior on the slope."""
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    ridge = np.diag([1e-6, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        g = design.T @ (weight * (y - p)) - ridge @ beta
        h = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fitted(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    rows = [(b" ".join(parted(r["text"]).split()), int(r["toxic"])) for r in labelled(docs, labels, settings).collect()]
    rows = list(dict.fromkeys(rows))  # copies once
    kinds = Counter(t for _, t in rows)
    if not kinds[0] or not kinds[1]:
        return Model({}, 1.0, 1.0, 0.0, 0.0, settings)
    distinct, texts = coded_words([w for w, _ in rows])
    toxic = [t for _, t in rows]
    counts = sample_counts(distinct, texts, toxic)
    # the tokens seen most often in toxic documents, as rarer ones cannot stand out
    counts = counts.filter(pc.greater(counts["toxic"], 0)).sort_by([("toxic", "descending"), ("feature", "ascending")])
    counts = counts.slice(0, settings.vocabulary).sort_by("feature")
    words = counts["feature"].to_pylist()
    corpus, holding = document_counts(docs, words)
    scores: dict[bytes, float] = {}
    for w, other, seen_toxic in zip(words, counts["other"].to_pylist(), counts["toxic"].to_pylist()):
        strength = settings.prior * kinds[1]
        a = strength * holding[w] / max(1, corpus) + 0.01
        rest = strength + 0.02 - a
        t, c = seen_toxic + a, other + a
        odds = math.log(t / max(0.01, kinds[1] - seen_toxic + rest)) - math.log(c / max(0.01, kinds[0] - other + rest))
        if abs(odds) >= settings.stands_out * math.sqrt(1 / t + 1 / c):
            scores[w] = max(-settings.highest, min(settings.highest, odds)) - settings.drift
    score_of = Model(scores, 1.0, 1.0, 0.0, 1.0, settings).token_scores(distinct)
    # lambda: chance sequences are those of the other documents
    seen = Counter()
    for text, t in zip(texts, toxic):
        if not t:
            seen.update(score_of[text].tolist())
    seen.update({v: 0.5 for v in scores.values()})
    values = np.array(list(seen))
    shares = np.array(list(seen.values())) / max(1, sum(seen.values()))

    def excess(x: float) -> float:
        return float((shares * np.exp(x * values)).sum()) - 1

    low, high = 1e-6, 1e-3
    while excess(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    decay = high
    found = [passages(score_of[text]) for text in texts]
    best = [(len(w), max((s for _, _, s in f), default=0.0), t) for w, f, t in zip(texts, found, toxic) if len(w)]
    chance = [(n, s) for n, s, t in best if not t]
    # K by maximum likelihood of the best scores of the other documents
    scale = len(chance) / max(1e-9, sum(n * math.exp(-decay * s) for n, s in chance))
    model = Model(scores, decay, scale, 0.0, 1.0, settings)
    x = np.array([model.evidence(len(w), f) for w, f in zip(texts, found)])
    y = np.array(toxic, float)
    offset, slope = logistic(np.minimum(x, 50.0), y, np.ones_like(y))
    return Model(scores, decay, scale, offset, max(0.0, slope), settings)


def scored(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, longest passage's start
    and length in tokens, for every row."""
    docs = docs.select("doc_id", "text")
    model = fitted(docs, labels.select("doc_id", "toxic"), settings)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("score", pa.float64()), ("n_passages", pa.int64()), ("passages", pa.string())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cut in slices(b):
                distinct, texts = coded_words([parted(t) for t in cut.column("text").to_pylist()])
                score_of, out = model.token_scores(distinct), []
                for i, text in zip(cut.column("doc_id").to_pylist(), texts):
                    found = passages(score_of[text])
                    kept = model.significant(len(text), found)
                    p = model.probability(min(50.0, model.evidence(len(text), found)))
                    out.append((i, p, len(kept), ",".join(f"{s}:{e}" for s, e, _ in kept)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    return (
        docs.mapInArrow(score, "doc_id long, score double, n_passages long, passages string")
        .withColumn("held_out", held_out(F.col("doc_id")))
        .withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))
        .select("doc_id", "held_out", "score", "predicted", "n_passages", "passages")
    )


def query(spark, folder: str) -> DataFrame:
    return scored(table(spark, folder, "documents"), table(spark, folder, "labels"))

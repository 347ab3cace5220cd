import random

import numpy as np
from pyspark.sql import functions as F

from figureyard.llm import toxicity
from figureyard.llm.common import coded_words
from figureyard.llm.language import held_out


def brute(s):
    """Maximal scoring subsequences by their recursive definition."""
    if not len(s):
        return []
    best = None
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            v = sum(s[i:j])
            if v > 0 and (best is None or v > best[2] or v == best[2] and j - i < best[1] - best[0]):
                best = (i, j, v)
    if best is None:
        return []
    i, j, v = best
    right = [(a + j, b + j, c) for a, b, c in brute(s[j:])]
    return brute(s[:i]) + [(i, j, v)] + right


def test_passages_are_the_maximal_ones():
    r = random.Random(5)
    for _ in range(200):
        # powers of two apart, so that sums do not tie
        s = [r.choice([-1, 1]) * (1 + r.random()) for _ in range(r.randrange(1, 14))]
        got = [(a, b) for a, b, _ in toxicity.passages(np.array(s))]
        assert got == [(a, b) for a, b, _ in brute(s)]


def test_passages_of_long_rows_take_linear_time():
    s = np.tile([1.0, -2.0], 200_000)
    assert len(toxicity.passages(s)) == 200_000


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.scored(docs, labels).where("held_out").join(labels, "doc_id").collect()
    found = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    wrong = sum(r.predicted == 1 and r.toxic == 0 for r in rows)
    toxic = sum(r.toxic == 1 for r in rows)
    assert found >= 0.9 * toxic and wrong <= 0.05 * toxic


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    rows = toxicity.scored(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(no_docs, labels).count() == 0
    none = toxicity.scored(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and {r.predicted for r in none} == {0}


def test_held_out_is_the_crc_of_the_id(spark):
    import zlib

    got = spark.range(200).withColumn("h", held_out(F.col("id"))).collect()
    assert [r.h for r in got] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)]


def test_words_are_coded_once_for_all_texts():
    distinct, texts = coded_words([b"a  b a", b"", b" b", b"  ", b"c "])
    words = distinct.to_pylist()
    assert [[words[i] for i in t] for t in texts] == [[b"a", b"b", b"a"], [], [b"b"], [], [b"c"]]
    assert words.count(b"a") == words.count(b"b") == 1
    assert coded_words([])[1] == []


def plain_features(word):
    return [word] + [word[:n] + toxicity.MARK for n in reversed(toxicity.BEGINNINGS) if n < len(word)]


def test_counts_and_scores_are_those_of_single_tokens(spark, small_docs, odd_docs):
    texts = [r.text for r in small_docs.select("text").union(odd_docs.select("text")).collect()]
    held = [{f for w in set(toxicity.parted(t).split()) for f in plain_features(w)} for t in texts]
    known = sorted(set().union(*held))[::3]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    n, found = toxicity.document_counts(docs, [*known, b"nowhere"])
    assert n == len(texts) and found == {f: c for f in known if (c := sum(f in h for h in held))}
    assert toxicity.document_counts(docs, []) == (len(texts), {})

    scores = {f: 1.0 + i % 7 for i, f in enumerate(known)}
    model = toxicity.Model(scores, 1.0, 1.0, 0.0, 1.0)
    distinct, coded = coded_words([toxicity.parted(t) for t in texts])
    want = {w: next((scores[f] for f in plain_features(w) if f in scores), -model.settings.drift) for w in distinct.to_pylist()}
    assert model.token_scores(distinct).tolist() == list(want.values()) and len(set(want.values())) > 3

    kinds = [i % 2 for i in range(len(texts))]
    counts = toxicity.sample_counts(distinct, coded, kinds).to_pylist()
    assert {r["feature"] for r in counts} >= set().union(*held)
    for r in counts[::50]:
        assert [r["other"], r["toxic"]] == [sum(r["feature"] in h for h, k in zip(held, kinds) if k == j) for j in (0, 1)]

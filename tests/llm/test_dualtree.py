"""Ranked search against scores of all pairs."""

import math
from collections import Counter

import numpy as np
import pytest

from figureyard.llm import dualtree
from figureyard.llm.common import alnum_words
from figureyard.llm.dualtree import Items, Search, ranked


def plainly(docs, items, k):
    bags = [(i, Counter(alnum_words(t))) for i, t in docs]
    total = sum(1 for _, b in bags if b)
    words = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 50 + (50 * sum(bag.values()) * total) // max(1, words)
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
                for t in set(alnum_words(text)) if t in bag
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("limits", [(1 << 18, (64, 8, 8), 50), (60, (2, 2, 3), 7)])
def test_small_table(spark, small_docs, monkeypatch, limits):
    monkeypatch.setattr(dualtree, "BLOCK_TERMS", limits[0])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()][:12]
    docs = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    found = ranked(small_docs, spark.createDataFrame(items, "item_id long, text string"), limits[2], limits[1])
    assert rows_of(found) == plainly(docs, items, limits[2])


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "Long; words"), (1, "short"), (None, "id text"), (3, None), (4, " - "), (5, "漢字 é"), (6, "nothing"), (7, "a a A text")]
    benchmark = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, item string, rank int")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert rows_of(ranked(odd_docs, benchmark, 3)) == plainly(docs, items, 3)
    assert ranked(no_docs, benchmark).collect() == []
    none = ranked(odd_docs, benchmark.where("false"))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_pruning_is_exact_and_prunes():
    r = np.random.default_rng(5)
    topics = [r.choice(400, 12, replace=False) for _ in range(20)]
    items = [sorted({*map(int, r.choice(topics[i % 20], 6))}) for i in range(60)]
    weights = r.integers(1, 3000, 400)
    tree = Items(items, weights)
    state = Search(tree, 5, 1000, 50_000)
    everything = []
    for c in range(3):
        rows = [np.unique(np.r_[r.choice(topics[r.integers(20)], 8), r.integers(0, 400, 3)]) for _ in range(3000)]
        sizes = np.array([len(t) for t in rows])
        terms, tf, n = np.concatenate(rows), r.integers(1, 4, int(sizes.sum())), r.integers(20, 90, len(rows))
        ids = list(range(c * 3000, c * 3000 + 3000))
        state.chunk(ids, n, sizes, terms, tf)
        value = state.worth(n, tf, sizes)
        everything += [(i, dict(zip(t.tolist(), v.tolist()))) for i, t, v in zip(ids, rows, np.split(value, np.cumsum(sizes)[:-1]))]
    for place, heap in enumerate(state.best.heaps):
        item = items[tree.order[place]]
        scores = sorted(((-sum(weights[t] * d.get(t, 0) for t in item), i) for i, d in everything))[:5]
        assert sorted((-s, -neg) for s, _, neg in heap) == scores
    assert state.scored < 60 * 9000 / 3

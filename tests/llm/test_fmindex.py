"""The index against plain search, and hits of documents against the definition."""

import random

import numpy as np
import pytest

from figureyard.llm import fmindex
from figureyard.llm.common import alnum_words
from figureyard.llm.fmindex import Phrases, Shard, built, contamination, decontaminated, suffix_order, without


def sample(seed: int, size: int = 400) -> tuple[np.ndarray, np.ndarray, int]:
    r = np.random.default_rng(seed)
    top = int(r.choice([1, 2, 5, 40]))
    docs = [r.integers(1, top + 1, int(r.integers(0, 60))) for _ in range(size // 40)]
    docs += docs[:4]
    x = np.concatenate([np.r_[d, 0] for d in docs]).astype(np.int64)
    starts = np.cumsum([0, *(len(d) + 1 for d in docs)])[:-1]
    return x, starts, top


@pytest.mark.parametrize("seed", range(20))
def test_suffixes_are_in_order(seed):
    x, _, top = sample(seed)
    marks = np.cumsum(x == 0) - len(x)  # separators differ and are below all words
    y = np.where(x == 0, marks, x).tolist()
    assert suffix_order(x, top).tolist() == sorted(range(len(x)), key=lambda i: y[i:])


@pytest.mark.parametrize("seed", range(20))
def test_search_and_locate(seed):
    x, starts, top = sample(seed, 800)
    counts, levels, marks, places = built(x, starts, top)
    shard = Shard(np.frombuffer(counts, "<i4").astype(np.int64), levels, marks, np.frombuffer(places, "<i4").astype(np.int64))
    r = random.Random(seed)
    cases = []
    for _ in range(60):
        m, at = r.randint(1, 6), r.randrange(len(x))
        p = [v for v in x[at : at + m].tolist() if v] or [1]
        cases.append(p if r.random() < 0.7 else [r.randint(0, top) for _ in range(m)])
    width = max(map(len, cases))
    matrix = np.array([[-1] * (width - len(p)) + p for p in cases])
    low, high = shard.ranges(matrix, np.array([len(p) for p in cases]))
    text = x.tolist()
    for p, a, b in zip(cases, low, high):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p and 0 not in p]
        assert sorted(shard.locate(np.arange(a, b)).tolist()) == want


def plainly(docs, items, window=10):
    tests = {}
    for item, text in items:
        w = alnum_words(text)
        for i in range(max(1, len(w) - window + 1)) if w else []:
            tests.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    sizes, out = {len(t) for t in tests}, []
    for doc, text in docs:
        w, hit, names = alnum_words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if owners := tests.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    names |= owners
        out.append((doc, len(w), sorted(hit), sorted(names)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(
        ((r["doc_id"], r["n_words"], [i for s in r["spans"] for i in range(s["start"], s["end"])], r["items"]) for r in df.collect()),
        key=str,
    )


@pytest.mark.parametrize("limits", [(1 << 19, 100_000), (64, 7)])
def test_documents_against_the_definition(spark, odd_docs, monkeypatch, limits):
    monkeypatch.setattr(fmindex, "BLOCK_ROWS", limits[1])
    items = [(1, "a short TEXT"), (1, "words stand here. Long"), (None, "No id,but words"), (3, None), (4, ""), (5, "漢字 🙂 é"),
             (6, "Long words stand here. " * 4), (7, "nowhere at all in any text of these rows"), (8, "short")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    df = contamination(odd_docs, benchmark, shard=limits[0])
    assert rows_of(df) == plainly(docs, items)


def test_small_table_cut_into_small_shards(spark, small_docs):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    want = plainly(docs, items)
    assert sum(bool(r[2]) for r in want) >= 3
    assert rows_of(contamination(small_docs, benchmark, shard=300)) == want


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(no_docs, none).collect() == []
    assert all(r["spans"] == [] and r["items"] == [] for r in contamination(odd_docs, none).collect())


def test_removal(spark, odd_docs):
    assert without("Ab, cd; ef. gh!", [{"start": 1, "end": 3}]) == "Ab, . gh!"
    assert without("é ab", [{"start": 0, "end": 1}]) == " ab"
    benchmark = spark.createDataFrame([(1, "words stand here. long")], "item_id long, text string")
    clashing = odd_docs.withColumnRenamed("rule", "spans").withColumnRenamed("label", "row").withColumnRenamed("lang", "place")
    out = decontaminated(clashing, benchmark)
    assert out.columns == clashing.columns and out.count() == 8
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[4] == "Long  words stand here. " and texts[2] is None and texts[1] == "A short text."
    assert Phrases([]).items == []

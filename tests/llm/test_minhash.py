import random
import re

import numpy as np
import pytest

from figureyard.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = WORD.findall(low)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(s), label[i]) for i, s in sets.items()}


def group(seed, n, edits):
    """Copies of one text, each with its own edits; some are linked only to others."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w).title() if r.random() < 0.1 else " ".join(w))
    return out


@pytest.mark.parametrize("k,percent", [(2, 80), (5, 80)])
def test_same_components_as_all_pairs(spark, k, percent):
    texts = group(1, 60, 24) + group(2, 40, 12) + ["one", "one", "ONE", "two words", "", None]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(df, k, percent).collect()}
    want = brute(rows, k, percent)
    assert got == want
    assert len({c for _, c in want.values()}) > 10


def test_estimates_follow_similarity():
    r = np.random.default_rng(3)
    union = r.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = union[:2400], union[600:]
    low = [minhash.minima(x) for x in (a, b)]
    same = np.mean((low[0] & np.uint64(3)) == (low[1] & np.uint64(3)))
    assert abs((same - 0.25) / 0.75 - 0.6) < 0.2
    # maps of parities never differ in more bits than the sets in elements
    maps = [np.array(minhash.parities(x), np.int64).view(np.uint8) for x in (a, b)]
    assert np.unpackbits(maps[0] ^ maps[1]).sum() <= 1200


def test_odd_rows(odd_docs, no_docs):
    rows = minhash.near_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].n_shingles == by[3].n_shingles == by[5].n_shingles == 0
    assert by[2].component_id == 2 and by[2].kept and by[None].kept
    assert sum(r.component_id == 1 for r in rows) == 2
    assert minhash.near_groups(no_docs).count() == 0


def test_rows_that_share_ids_and_repeat(spark):
    from figureyard.llm.minhash import one_of_each

    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    half = " ".join([*(f"a{i}" for i in range(45)), *(f"c{i}" for i in range(15))])  # shares bands, not a link
    rows = [(1, a), (7, a), (7, b), (9, b + " x"), (None, a), (None, "z y x w v u"), (3, ""), (3, None)]
    rows += [(20, half)] * 300 + [(21, a + " tail")] * 300 + [(20, half + " more")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = minhash.near_groups(docs, k=2, percent=80).collect()
    assert len(found) == len(rows)
    by_row = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in found}
    assert by_row[(1, 59)] == by_row[(None, 59)] == by_row[(21, 60)] == 1
    assert by_row[(9, 60)] == 7 and by_row[(None, 5)] is None and by_row[(3, 0)] == 3
    assert {r["component_id"] for r in found if r["doc_id"] == 7} == {1, 7}
    assert {r["component_id"] for r in found if r["doc_id"] == 20} == {20}
    kept = sorted((r["doc_id"] or 0, (r["text"] or "")[:4]) for r in one_of_each(docs, k=2).collect())
    assert kept == [(0, "z y "), (1, "a0 a"), (3, ""), (3, ""), (7, "b0 b"), (20, "a0 a")]


def test_sketches_are_those_of_each_text_alone(spark, odd_docs, small_docs):
    import xxhash

    rows = [r.text for r in small_docs.limit(60).union(odd_docs.select(small_docs.columns)).collect()]
    rows += ["Tabs\tand\nlines  between", "tabs and lines between"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    docs = docs.selectExpr("doc_id as place", "doc_id", "text")
    got = sorted(minhash.sketches(docs, 5).collect(), key=lambda r: r.place)
    for r, text in zip(got, rows):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        s = minhash.shingles(minhash.mixed(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)), 5)
        assert r.n == len(s) == len(np.unique(s)) and (r.bands is None) == (not words)
        if words:
            low = minhash.minima(s)
            assert r.parity == minhash.parities(s)
            assert [r.sig] == minhash.packed(low[None]).tolist() and [r.bands] == minhash.band_keys(low[None]).tolist()
    assert got[-1].digest == got[-2].digest

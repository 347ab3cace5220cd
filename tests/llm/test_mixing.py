import re
from collections import defaultdict

from figureyard.llm import mixing


def want_targets(sizes, total=1.5, most=2.0):
    """The rule as told: share, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    target, budget, free = {}, total * sum(sizes.values()), set(names)
    while free:
        share = budget / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            budget -= target[s]
        free -= over
    return target


def check(df, near=2.0):
    rows = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for r in df.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    target, taken, longest = want_targets(sizes), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - target[r.source]) <= 1e-6 * max(1, r.target)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s] / near + 1e-6
    return rows


def test_targets_and_taken(small_docs):
    rows = check(small_docs)
    again = mixing.mix(small_docs.repartition(5)).drop("place").collect()
    assert sorted(tuple(r)[:-1] for r in rows) == sorted(map(tuple, again))


def test_inclusion_follows_merit(spark):
    df = spark.createDataFrame(
        [(i, "w w w w", "a" if i < 400 else "b", float(1 + 8 * (i % 2))) for i in range(800)],
        "doc_id long, text string, source string, m double",
    )
    rows = mixing.mix(df, total=0.5, most=1.0, merit="m").collect()
    odd = sum(r.taken > 0 for r in rows if r.doc_id % 2)
    even = sum(r.taken > 0 for r in rows if r.doc_id % 2 == 0)
    assert odd > 1.5 * even > 0


def test_odd_rows(spark, odd_docs, no_docs):
    check(odd_docs)
    assert mixing.mix(no_docs).count() == 0
    hot = spark.createDataFrame([(i, f"a{i} b c", "s") for i in range(300)], "doc_id long, text string, source string")
    check(hot)
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns


def test_repeated_ids_do_not_share_their_copies(spark, tmp_path):
    from figureyard.llm.mixing import mix, mixed_documents

    rows = [(i % 5, "w " * (i % 13 + 1), "s", i, i, i) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, _copy int, copies int, place int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    wanted = mix(docs).selectExpr("sum(taken) t").first()["t"]
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(r.text.split()) for r in out.collect()) == wanted


def test_long_documents_are_likelier(spark):
    rows = [(i, "w " * (4 if i % 2 else 100), "s") for i in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), total=0.5).collect()
    share = {n: sum(r.taken > 0 for r in out if r.size == n) / 2000 for n in (4, 100)}
    assert share[100] > share[4] + 0.2

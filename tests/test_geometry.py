import random

from pyspark.sql import functions as F

from figureyard.operators import geometry, planar


def _area(r):
    return max(r[2] - r[0], 0) * max(r[3] - r[1], 0)


def _share(a, b):
    inter = _area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))
    return inter / min(_area(a), _area(b)) if inter > 0 else 0.0


def _rects(n, seed, size=(20, 200)):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        x, y = rnd.randint(0, 400), rnd.randint(0, 560)
        out.add((x, y, x + rnd.randint(*size), y + rnd.randint(*size)))
    return sorted(out)


def _frame(spark, pages):
    rows = [(p, "image", *r, float(_area(r))) for p, rs in pages.items() for r in rs]
    return spark.createDataFrame(
        rows, "page long, kind string, x0 int, y0 int, x1 int, y1 int, area_frac double"
    )


def _greedy(rects):
    kept = []
    for r in sorted(rects, key=lambda r: (-_area(r), r)):
        if all(_share(r, k) < 0.6 for k in kept):
            kept.append(r)
    return set(kept)


def test_suppression_of_small_and_hot_pages_is_greedy(spark):
    pages = {1: _rects(12, 1), 2: _rects(150, 2), 3: _rects(1, 3)}
    # 150 candidates with 16 per round takes the route of crowded pages
    for piece in (512, 100, 5):
        out = geometry.suppress(_frame(spark, pages), "page", per_round=16, piece=piece).collect()
        for p, rects in pages.items():
            assert {(r.x0, r.y0, r.x1, r.y1) for r in out if r.page == p} == _greedy(rects)


def test_rects_covered_by_others_are_found_through_tiles(spark):
    pages = {p: _rects(40, 10 + p) for p in range(4)}
    others = {p: _rects(25, 50 + p, (5, 300)) for p in range(4)}
    out = geometry.not_covered(_frame(spark, pages), _frame(spark, others), "page").collect()
    for p in pages:
        want = {r for r in pages[p] if not any(_share(r, o) > 0.6 for o in others[p])}
        assert {(r.x0, r.y0, r.x1, r.y1) for r in out if r.page == p} == want


def _merged(rects, gap=14):
    rects = [list(r) for r in rects]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(rects):
            for j, b in enumerate(rects):
                if i < j and a[0] - gap < b[2] and a[2] + gap > b[0] and a[1] - gap < b[3] and a[3] + gap > b[1]:
                    rects[i] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
                    del rects[j]
                    changed = True
                    break
            if changed:
                break
    return {tuple(float(v) for v in r) for r in rects}


def test_merging_to_the_end(spark):
    pages = {1: _rects(60, 5, (4, 30)), 2: _rects(9, 6, (4, 20)), 3: _rects(1, 7)}
    # small pieces take the route of crowded pages
    for piece in (512, 20, 3):
        out = geometry.merge_rects(_frame(spark, pages), "page", piece=piece).collect()
        for p, rects in pages.items():
            found = [(r.x0, r.y0, r.x1, r.y1) for r in out if r.page == p]
            assert len(found) == len(set(found)) and set(found) == _merged(rects)


def test_pieces_of_a_crowded_page_are_bounded(spark):
    """100,000 boxes of one page in one tile, beside small pages."""
    hot = spark.range(100_000).selectExpr(
        "7L AS page", "cast(id % 300 AS int) / 3 AS x0", "cast(id / 300 AS int) / 4 AS y0"
    ).selectExpr("page", "x0", "y0", "x0 + 1 AS x1", "y0 + 1 AS y1")
    small = spark.createDataFrame(
        [(1, 0.0, 0.0, 5.0, 5.0), (1, 100.0, 0.0, 105.0, 5.0)], hot.schema
    )
    boxes = hot.union(small)
    sizes = planar.in_pieces(boxes, "page").groupBy("page", "piece", "alone").count().collect()
    assert sum(r["count"] for r in sizes) == 100_002
    hot_pieces = [r for r in sizes if not r.alone]
    assert {r.page for r in hot_pieces} == {7} and len(hot_pieces) > 190
    assert max(r["count"] for r in hot_pieces) < 2 * planar.PIECE
    out = {(r.page, r.x0, r.y0, r.x1) for r in geometry.merge_rects(boxes, "page").collect()}
    assert {r[1:] for r in out if r[0] == 1} == {(0.0, 0.0, 5.0), (100.0, 0.0, 105.0)}
    assert len(out) == 3


def test_nulls_and_empty_tables_of_rects(spark):
    schema = "page long, kind string, x0 int, y0 int, x1 int, y1 int, area_frac double"
    rows = [(None, "image", 0, 0, 9, 9, 1.0), (1, None, 0, 0, 9, 9, None), (1, "image", None, 0, 9, 9, 1.0),
            (1, "image", 50, 50, 60, 60, 1.0), (1, "image", 50, 50, 60, 60, 1.0)]
    df = spark.createDataFrame(rows, schema)
    for piece in (512, 1):
        assert sorted(r.x0 for r in geometry.merge_rects(df, "page", piece=piece).collect()) == [0.0, 50.0]
        assert sorted(r.x0 for r in geometry.suppress(df, "page", piece=piece).collect()) == [0, 50]
    assert geometry.merge_rects(df.limit(0), "page").count() == 0
    assert geometry.suppress(df.limit(0), "page").count() == 0


def _united(spark, boxes):
    df = spark.createDataFrame([(1, *b) for b in boxes], "page long, x0 int, y0 int, x1 int, y1 int")
    return sorted((r.x0, r.y0, r.x1, r.y1) for r in geometry.merge_rects(df, "page").collect())


def test_touching_boxes_stay_apart(spark):
    assert len(_united(spark, [(0, 0, 10, 10), (24, 0, 30, 10)])) == 2
    assert _united(spark, [(0, 0, 10, 10), (23, 0, 30, 10)]) == [(0, 0, 30, 10)]


def test_merged_hull_can_reach_a_third_box(spark):
    assert _united(spark, [(0, 0, 10, 10), (15, 40, 25, 50), (5, 20, 8, 30)]) == [(0, 0, 25, 50)]


def test_boxes_of_all_sizes_meet(spark):
    huge = (0, 0, 1_000_000, 1_000_000)
    assert _united(spark, [huge, (500, 500, 501, 501), (-2000, 0, -1000, 90)]) == [
        (-2000, 0, -1000, 90), huge,
    ]
    apart = [(40 * i % 8000, 40 * (i // 200), 40 * i % 8000 + 5, 40 * (i // 200) + 5) for i in range(8000)]
    assert len(_united(spark, apart)) == 8000


def test_a_huge_drawing_covers_small_boxes(spark):
    schema = "page long, x0 int, y0 int, x1 int, y1 int"
    small = spark.createDataFrame([(1, 900_000, 900_000, 900_010, 900_010), (1, -50, -50, -9, -9)], schema)
    huge = spark.createDataFrame([(1, 0, 0, 1_000_000, 1_000_000)], schema)
    assert [r.x0 for r in geometry.covered_by(small, huge, "page").collect()] == [900_000]


def test_captions_of_a_page(spark):
    figs = spark.createDataFrame(
        [(1, 0, 0, 100, 100), (1, 300, 0, 400, 100), (2, 0, 0, 50, 50), (3, 0, 0, 90, 90)],
        "page long, x0 int, y0 int, x1 int, y1 int",
    )
    blocks = spark.createDataFrame(
        [
            (1, 0, 110, 90, "some   text"), (1, 0, 150, 90, "\n\tFigure 1: a\nthing"), (1, 0, 160, 90, "more"),
            (1, 310, 300, 380, "just prose"), (1, 310, 361, 380, "too far"),
            (2, 60, 60, 90, "beside"), (2, 0, 70, 90, "  "),
            (3, 0, 95, 90, "Table 2"), (3, 5, 95, 90, "Table 2"), (3, 5, 99, 90, "after"),
        ],
        "page long, bx0 int, by0 int, bx1 int, txt string",
    )
    out = {(r.page, r.x0): r.caption for r in geometry.captions(figs, blocks, "page").collect()}
    assert out == {
        (1, 0): "Figure 1: a thing more", (1, 300): "just prose", (2, 0): "",
        (3, 0): "Table 2 Table 2",
    }


def test_candidates_are_clipped_and_filtered(spark):
    df = spark.createDataFrame(
        [
            (1, "image", -50, 0, 200, 200), (1, "image", 0, 0, 612, 792), (1, "image", 0, 0, 50, 500),
            (1, "image", 0, 0, 600, 60), (1, "vector", 0, 0, 2, 700), (1, "vector", 10, 10, 200, 200),
        ],
        "page long, kind string, x0 int, y0 int, x1 int, y1 int",
    )
    out = geometry.figure_candidates(df, F.lit(612), F.lit(792)).collect()
    assert {(r.kind, r.x0, r.x1) for r in out} == {("image", 0, 200), ("vector", 10, 200)}


def test_captions_shuffle_figures_and_blocks_once(spark):
    figs = spark.createDataFrame([(1, 0, 0, 50, 40), (1, 0, 0, 50, 40), (2, 0, 0, 50, 700)], "page long, x0 long, y0 long, x1 long, y1 long")
    blocks = spark.createDataFrame(
        [(1, 5, 300, 90, 312, "Figure 1"), (1, 5, 300, 90, 313, "Figure 1 "), (1, 5, 299, 90, 310, "near"), (1, 5, 301, 90, 310, "far")],
        "page long, bx0 long, by0 long, bx1 long, by1 long, txt string",
    )
    out = geometry.captions(figs, blocks, "page")
    plan = out._jdf.queryExecution().executedPlan().toString()  # before it adapts
    assert {(r.page, r.caption) for r in out.collect()} == {(1, "Figure 1 Figure 1"), (2, "")}
    joins = plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin")
    assert joins == 2 and plan.count("hashpartitioning(") <= 4

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from figureyard.functions import columns as c
from figureyard.functions import pixels
from figureyard.functions.pixels import pixel_stats
from figureyard.operators import datasets, gates, registry


def test_the_four_synthetic_crops(spark):
    rnd = random.Random(0)
    white = bytes(255 - rnd.randint(0, 4) for _ in range(250 * 250))
    noise = bytes(rnd.randint(0, 255) for _ in range(250 * 250))
    rows = [
        ("white", 9000, 500, 500, white), ("noise", 90000, 500, 500, noise),
        ("strip", 90000, 2000, 100, noise), ("tiny", 4000, 50, 50, noise),
        ("small", 9000, 50, 500, noise),
    ]
    df = spark.createDataFrame(rows, "name string, bytes long, w int, h int, px binary")
    df = df.withColumn("s", pixel_stats("px", F.lit(250)))
    reason = gates.crop_reject_reason(
        F.col("bytes"), F.lit(True), F.col("w"), F.col("h"), F.col("s.std"), F.col("s.content_frac")
    )
    out = {r.name: r.reason for r in df.select("name", reason.alias("reason")).collect()}
    assert out == {"white": "near-blank", "noise": "", "strip": "extreme-aspect",
                   "tiny": "tiny-file", "small": "tiny-dims"}


def test_missing_file_passes_and_unreadable_does_not(spark):
    df = spark.createDataFrame([(None, True), (9000, False)], "b long, ok boolean")
    reason = gates.crop_reject_reason(F.col("b"), F.col("ok"), F.lit(500), F.lit(500))
    assert [r.r for r in df.select(reason.alias("r")).collect()] == ["", "unreadable"]


def test_pixel_features_of_a_known_crop(spark):
    grey = np.array([[0, 10, 250], [0, 30, 250]], dtype=np.uint8)
    df = spark.createDataFrame([(1, grey.tobytes()), (2, b""), (3, None)], "k int, px binary")
    rows = {r.k: r.s for r in df.select("k", pixel_stats("px", F.lit(3)).alias("s")).collect()}
    assert rows[3] is None and list(rows[2]) == [0.0, 0.0, 0.0, 0, 0.0, 0.0]
    std, content, edge, colours, light, dark = rows[1]
    flat = grey.astype(float).ravel()
    assert abs(std - flat.std()) < 1e-9
    assert content == 3 / 6  # the smallest of the two modes, 0, is the mode
    assert abs(edge - (20 / 3 + (10 + 240 + 30 + 220) / 4)) < 1e-9
    assert (colours, light, dark) == (1, 2 / 6, 4 / 6)


def test_reject_reasons_map_to_classes(spark):
    cases = {
        "local:tiny-file": ("fragment_junk", "local"), "llm:Data Plot": ("data_plot", "llm"),
        "llm:graph of x": ("data_plot", "llm"), "llm:SEM micrograph": ("photo", "llm"),
        "llm:blurry": ("fragment_junk", "llm"), "a photograph": ("photo", "llm"),
        "llm:photo of a chart": ("data_plot", "llm"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "r string")
    made = gates.silver_class(F.lit("rejected"), F.col("r"))
    out = {r.r: (r.m.cls, r.m.source) for r in df.select("r", made.alias("m")).collect()}
    assert out == cases


def test_decision_needs_a_label_and_names_a_reason(spark):
    rows = [(True, "x", ""), (True, "  ", ""), (False, "x", " blank "), (None, None, None)]
    df = spark.createDataFrame(rows, "d boolean, l string, r string")
    cols = gates.crop_decision(F.col("d"), F.col("l"), F.col("r"))
    out = [tuple(r) for r in df.select(*[v.alias(k) for k, v in cols.items()]).collect()]
    assert out == [("labeled", ""), ("rejected", "llm:not-a-diagram"), ("rejected", "llm:blank"),
                   ("rejected", "llm:not-a-diagram")]


def test_box_gate(spark):
    df = spark.sql(
        "SELECT array(named_struct('cls','figure','conf',0.4D,'xyxy',array(0D,0D,200D,200D)),"
        "named_struct('cls','table','conf',0.9D,'xyxy',array(0D,0D,600D,700D))) AS b, array(612, 792) AS wh"
    )
    def gate(conf, frac):
        return df.select(gates.box_gate(F.col("b"), F.col("wh"), conf, frac).alias("g")).first().g
    assert (gate(0.4, 0.05), gate(0.5, 0.05), gate(0.4, 0.1)) == (1, 0, 0)


def test_splits_follow_half_even_sizes_and_never_leak(spark):
    papers = spark.createDataFrame(
        [(f"p{i:04d}v1", "a" if i < 150 else "b" if i < 165 else "c") for i in range(166)],
        "arxiv_id string, field string",
    )
    rows = datasets.assign_splits(papers).collect()
    sizes = {f: [sum(r.field == f and r.split == s for r in rows) for s in ("train", "val", "test")]
             for f in "abc"}
    # 15 * 0.7 = 10.5 rounds to 10, 15 * 0.15 = 2.25 to 2
    assert sizes == {"a": [105, 22, 23], "b": [10, 2, 3], "c": [1, 0, 0]}
    again = {r.arxiv_id: r.split for r in datasets.assign_splits(papers.repartition(3)).collect()}
    assert again == {r.arxiv_id: r.split for r in rows}
    both = datasets.with_split(papers.unionByName(papers), datasets.assign_splits(papers))
    assert datasets.split_violations(both).count() == 0


def test_field_of_a_crop_wins_over_its_page(spark):
    crops = spark.createDataFrame([("p1", "x")], "arxiv_id string, field string")
    pages = spark.createDataFrame([("p1", "a"), ("p2", "b")], "arxiv_id string, field string")
    out = {r.arxiv_id: r.field for r in datasets.paper_fields(crops, pages).collect()}
    assert out == {"p1": "x", "p2": "b"}


def test_cap_keeps_every_other_crop(spark):
    rows = [(i, "local" if i % 2 else "llm") for i in range(100)]
    df = spark.createDataFrame(rows, "image_id long, source string")
    out = datasets.cap_trivial(df, 7).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in out} == {"llm": 50, "local": 7}


def test_short_samples_repeat_in_turn(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    out = [r.k for r in datasets.repeated_sample(df, "k", 8).orderBy("pos").collect()]
    assert out[:3] == out[3:6] and out[6:] == out[:2] and set(out) == {1, 2, 3}


def test_version_is_only_a_trailing_number(spark):
    df = spark.createDataFrame([("2601.00001v12",), ("solv-int/9701",), ("a/1v2",)], "i string")
    out = [tuple(r) for r in df.select(c.base_id(F.col("i")), c.safe_name(F.col("i"))).collect()]
    assert out == [("2601.00001", "2601.00001v12"), ("solv-int/9701", "solv-int_9701"), ("a/1", "a_1v2")]


def test_overlap_counts_an_empty_second_rect_as_one(spark):
    def rect(a, b, x, y):
        return {"x0": F.lit(a), "y0": F.lit(b), "x1": F.lit(x), "y1": F.lit(y)}
    row = spark.range(1).select(
        c.overlap(rect(0, 0, 10, 10), rect(5, 5, 15, 15)).alias("a"),
        c.overlap(rect(0, 0, 10, 10), rect(10, 0, 20, 10)).alias("b"),
        c.overlap(rect(0, 0, 10, 10), rect(2, 2, 2, 8)).alias("z"),
    ).first()
    assert tuple(row) == (0.25, 0.0, 0.0)


def test_suffixes_and_failure_classes(spark):
    df = spark.createDataFrame([("a.PNG", 402), ("b", 429), ("c.tiff", 404), ("d.jpg", 200)], "n string, s int")
    out = [tuple(r) for r in df.select(c.suffix_of(F.col("n")), c.media_type(F.col("n")),
                                       c.failure_class(F.col("s"))).collect()]
    assert out == [("png", "image/png", "fatal"), ("jpeg", "image/jpeg", "retry"),
                   ("jpeg", "image/jpeg", "final"), ("jpg", "image/jpeg", "ok")]


def test_page_costs_add_up_and_image_costs_are_replaced(spark):
    log = spark.createDataFrame(
        [(1, 1, "screen_pos", 0.5, None), (1, 2, "failed", 0.25, "x" * 600), (2, 3, "labeled", 2.0, None)],
        "k int, seq int, status string, cost double, error string",
    )
    page = {r.k: r for r in registry.fold_log(log, "k", "seq", "cost", True).collect()}
    image = {r.k: r for r in registry.fold_log(log, "k", "seq", "cost", False).collect()}
    assert (page[1].status, page[1].cost, page[1].failures, len(page[1].error)) == ("failed", 0.75, 1, 500)
    assert image[1].cost == 0.25


def test_registration_keeps_the_first_arrival(spark):
    batch = spark.createDataFrame(
        [("1", "1v1", "a", 3), ("1", "1v2", "b", 1), ("2", "2v1", "a", 2), ("3", "3v1", "a", 4)],
        "base_id string, arxiv_id string, field string, at int",
    )
    known = spark.createDataFrame([("3",)], "base_id string")
    out = {tuple(r) for r in registry.register_first_wins(batch, known, "at").collect()}
    assert out == {("1", "1v2", "b", 1), ("2", "2v1", "a", 2)}


def test_white_space_is_no_label_and_no_reason(spark):
    df = spark.createDataFrame([("\n", "\t x \n"), (" ok\n", ""), ("", "\n")], "label string, reason string")
    out = gates.crop_decision(F.lit(True), F.col("label"), F.col("reason"))
    rows = df.select(*[v.alias(k) for k, v in out.items()]).collect()
    assert [tuple(r) for r in rows] == [
        ("rejected", "llm:x"), ("labeled", ""), ("rejected", "llm:not-a-diagram"),
    ]


def test_an_unknown_status_stays(spark):
    log = spark.createDataFrame([(1, 1, "odd", "e" * 900, 1.0)], "k int, seq int, status string, error string, cost double")
    row = registry.fold_log(log, "k", "seq", "cost", True).first()
    assert row.status == "odd" and len(row.error) == 500


def test_interrupted_work_goes_back_without_its_error(spark):
    rows = [(1, "failed", "x"), (2, "processing", "y"), (3, "done", "z"), (4, None, None)]
    df = spark.createDataFrame(rows, "k int, status string, error string")
    out = {r.k: (r.status, r.error, r.requeued) for r in registry.requeue_failed(df, "processing").collect()}
    assert out == {
        1: ("pending", None, True), 2: ("pending", None, True), 3: ("done", "z", False), 4: (None, None, False),
    }


def test_equal_large_values_have_no_deviation(spark):
    out = spark.createDataFrame([(123456789.0,)] * 3, "v double").agg(F.stddev_pop("v").alias("s")).first()
    assert out.s == 0


def test_long_documents_keep_their_pages(spark, tmp_path):
    from figureyard.sources import tables

    rows = [(1, "First line\nrest", "en", "s", 30 * 500 - 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert tables.pages(spark, str(tmp_path)).count() == 30
    assert tables.papers(spark, str(tmp_path)).first().title == "First line"


def test_counts_of_crops_leave_in_slices():
    blobs = [bytes([i % 256] * (i % 7)) if i % 5 else None for i in range(1000)]
    batch = (pa.array(blobs, pa.binary()), pa.array([2] * 1000))
    parts = list(pixels.pixel_counts.func(iter([batch])))
    assert max(map(len, parts)) <= pixels.SLICE
    rows = [r for p in parts for r in p.to_pylist()]
    for blob, row in zip(blobs, rows, strict=True):
        hist, edge, colors = pixels.counted(blob, 2)
        assert row == {"hist": None if hist is None else hist.tolist(), "edge": edge, "colors": colors}


def test_measures_pass_over_held_levels_only(spark):
    rnd = random.Random(3)
    blobs = [bytes(rnd.choice([7, 40, 250]) for _ in range(n)) for n in (0, 1, 90)]
    df = spark.createDataFrame(list(enumerate(blobs)), "k int, px binary").withColumn("c", pixels.pixel_counts("px", F.lit(9)))
    out = df.select("k", pixels.held_levels(F.col("c.hist")).alias("held"), pixels.measures(F.col("c")).alias("m"))
    for r in out.collect():
        flat = np.frombuffer(blobs[r.k], np.uint8).astype(float)
        levels, counts = np.unique(flat, return_counts=True)
        assert [(x.h, x.level) for x in r.held] == list(zip(counts, levels))
        if len(flat):
            mode = levels[counts.argmax()]
            assert abs(r.m["std"] - flat.std()) < 1e-9 and r.m.content_frac == (abs(flat - mode) > 16).mean()
            assert (r.m.light_frac, r.m.dark_frac) == ((flat > 240).mean(), (flat < 32).mean())

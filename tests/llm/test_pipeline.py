import corpus_pipeline
from figureyard.llm import quality
from figureyard.session import shared_path
from tests.llm.test_minhash import brute
from tests.llm.test_packing import check as check_pieces
from tests.llm.test_pii import brute as brute_spans


def test_stages(spark, small_docs):
    folder = "/root/testdata/sf0.001"
    docs, kept = small_docs, {}
    for name, fn in corpus_pipeline.STAGES:
        path = shared_path(spark, name)
        fn(spark, docs, folder).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == small_docs.columns

    before, after = kept["quality_rules"]
    good = {r.doc_id for r in quality.measures(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == good

    before, after = kept["minhash_near_dedup"]
    groups = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)

    before, after = kept["pii"]
    assert after.count() == before.count()
    assert not any(brute_spans(r.text) for r in after.collect())

    before, after = kept["mixing"]
    ids = {r.doc_id for r in before.collect()}
    copies = [r.doc_id for r in after.collect()]
    assert set(copies) <= ids and max(map(copies.count, set(copies))) <= 2

    before, _ = kept["packing"]
    assert check_pieces(before.dropDuplicates(["doc_id"]).coalesce(1))[0] <= 2048


def test_run_gives_pieces(spark):
    df = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset"} <= set(df.columns) and df.count() > 0


CLASHING = ["_h", "h", "spans", "_copy", "_copies", "_words", "_lines", "lines", "kept", "n_words", "row", "place"]


def test_stages_keep_columns_with_clashing_names(spark, small_docs, tmp_path):
    base = small_docs.limit(60).collect()
    rows = [(*r, *range(len(CLASHING))) for r in base] + [(None, *base[0][1:], *range(len(CLASHING)))] * 3
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "0"))
    docs = spark.read.parquet(str(tmp_path / "0"))
    for i, (_, fn) in enumerate(corpus_pipeline.STAGES[:-1], 1):
        out = fn(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.where(" or ".join(f"{c} <> {k}" for k, c in enumerate(CLASHING))).isEmpty()
    assert docs.count() > 20

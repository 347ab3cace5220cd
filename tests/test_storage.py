import hashlib
import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from figureyard import schemas
from figureyard.functions import replies
from figureyard.operators import datasets, models
from figureyard.plans import curation, registered, storage
from figureyard.sinks import pieces, stores
from figureyard.sources import scans

FOLDER = "/root/testdata/sf0.001"

def test_replies_with_common_slips(spark):
    texts = [
        'Sure:\n```json\n{"is_diagram": true, "title": "a"}\n``` bye',
        '{"is_diagram": true, "label": "two\nlines"}',
        '{"label": "angle \\alpha"}', '{"label": "\\frac{1}{2}"}', '{"label": "x\\rangle"}',
        "no object", '{"label": "open', '{"label": "ok"} trailing words',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, reply string")
    out = replies.parse_replies(df, "reply", schemas.LABEL_REPLY, replies.LABEL_DEFAULTS).orderBy("i").collect()
    assert out[0].parsed.is_diagram is True and out[0].parsed.title == "a" and out[0].parsed.label == ""
    assert [out[i].parsed.label for i in (1, 2, 3, 4, 7)] == [
        "two\nlines", "angle \\alpha", "\\frac{1}{2}", "x\\rangle", "ok"]
    assert (out[5].parse_error, out[6].parse_error) == ("no JSON object", "invalid JSON")
    assert out[5].parsed is None and out[2].parsed.is_diagram is False


def test_request_context(spark):
    df = spark.sql(
        "SELECT array(named_struct('type','flowchart','description','a'),"
        "named_struct('type',cast(null as string),'description',cast(null as string))) AS d, 'sum' AS s"
    )
    line = replies.context_lines(F.col("d"), F.col("s"))
    none = replies.context_lines(F.lit(None).cast("array<struct<type:string,description:string>>"), F.lit(""))
    row = df.select(line.alias("a"), replies.request_text(F.lit(3), F.lit("T"), F.lit("f"), F.lit(" "), none).alias("b")).first()
    assert row.a == "- flowchart: a\n- diagram: \nPage summary: sum"
    assert "(no OCR text available)" in row.b and row.b.endswith("(none)")


def test_feed_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/abs/2601.1v2</id><title>A\n  b</title>'
        "<summary> s </summary><published>2026-01-02T00:00:00Z</published><author><name>N</name></author>"
        '<link title="pdf" href="http://x/p"/></entry><entry><id>http://x/abs/2601.2v1</id><title>C</title>'
        "<published>2026-01-03T00:00:00Z</published><author><name>M</name></author><author><name>O</name></author>"
        '<link title="doi" href="http://d"/></entry></feed>'
    )
    out = {r.arxiv_id: r for r in scans.read_feed(spark, str(tmp_path)).collect()}
    assert out["2601.1v2"].title == "A b" and out["2601.1v2"].pdf_url == "http://x/p"
    assert out["2601.1v2"].published == "2026-01-02" and out["2601.1v2"].abstract == "s"
    assert out["2601.2v1"].pdf_url == "https://arxiv.org/pdf/2601.2v1" and out["2601.2v1"].authors == ["M", "O"]


def test_journal_of_one_file_per_record(spark, tmp_path):
    (tmp_path / "page_003.json").write_text('{"page_no": 3,\n "has_diagram": true}')
    (tmp_path / "page_004.json").write_text("{oops")
    good, bad = scans.read_journal(spark, str(tmp_path), "page_no INT, has_diagram BOOLEAN", whole_files=True)
    assert [(r.page_no, r.file_page) for r in good.collect()] == [(3, 3)]
    assert [r.file_page for r in bad.collect()] == [4]


def test_sidecar_files_are_not_assets(spark, tmp_path):
    for name, size in (("a.png", 5), ("._a.png", 5), ("b.txt", 2)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert [(r.name, r.bytes) for r in scans.list_assets(spark, str(tmp_path), "*.png").collect()] == [("a.png", 5)]


def test_gallery_document(spark, tmp_path):
    doc = {"base": "b", "images": [{"url": "v3/img/f/x.png", "category": "f", "arxiv_id": "1", "page": 2}]}
    (tmp_path / "data.json").write_text(json.dumps(doc, indent=1))
    out = scans.read_gallery(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in out] == [("v3/img/f/x.png", "f", 2, "", "1")]


def test_prediction_scan_prunes_directories(spark, tmp_path):
    path = str(tmp_path / "p")
    stores.save_predictions(storage._prediction_sets(spark, FOLDER), path)
    df = scans.read_predictions(spark, path, "model_a", "val")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(name" in plan and df.count() > 0


def test_anonymised_export_has_no_source(spark):
    full, bare = storage._written_exports(spark, FOLDER)
    a, b = spark.read.parquet(full), spark.read.parquet(bare)
    assert a.columns == list(stores.WITH_SOURCE) and b.columns == list(stores.WITHOUT_SOURCE)
    secret = {v for r in a.select("ArXiv ID", "Abstract URL", "Source Image Path").collect() for v in r}
    shown = {str(v) for r in b.collect() for v in r}
    assert a.count() == b.count() > 0 and not secret & shown


def test_split_digest_sees_every_change(spark):
    s = curation.splits(spark, FOLDER)
    one = datasets.split_digest(s).first()
    assert one == datasets.split_digest(s.repartition(5)).first() and len(one.manifest_sha) == 16
    moved = s.withColumn("split", F.when(F.col("arxiv_id") == F.lit("000001v2"), "none").otherwise(F.col("split")))
    assert datasets.split_digest(moved).first().manifest_sha != one.manifest_sha


def test_cache_is_written_once(spark, tmp_path):
    path = str(tmp_path / "c")
    one = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "image_id long, embedding array<float>")
    first = stores.cache_embeddings(one, path, "m").first()
    assert (first.n, first.skipped, first.dim) == (2, 1, 2)
    rows = {r.image_id: list(r.embedding) for r in spark.read.parquet(path).collect()}
    assert np.allclose(rows[1], [0.6, 0.8]) and rows[2] == [0.0, 0.0]
    files = sorted(p.name for p in (tmp_path / "c").iterdir())
    assert stores.cache_embeddings(one.repartition(3), path, "m").first() == first
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == files
    # other vectors, or a cache without its description, are written anew
    assert stores.cache_embeddings(one.limit(1), path, "m").first().n == 1
    shutil.rmtree(tmp_path / "c-about")
    assert stores.cache_embeddings(one, path, "m").first().n == 2
    assert stores.cache_embeddings(one, path, "m", force=True).first().n == 2


def test_ocr_pages_fold_by_index(spark):
    df = spark.createDataFrame(
        [(7, [("a", 3), ("b", 9)], ([(0, "m", [("x.png", "data:image/png;base64,QQ=="), ("y", None), ("z.jpg", "Qg==")]),
                                     (5, "m", [("q", "QQ==")])],))],
        "batch_id int, manifest array<struct<arxiv_id:string,page_no:int>>, response struct<" + 
        "pages:array<struct<index:int,markdown:string,images:array<struct<id:string,image_base64:string>>>>>",
    )
    out = [(r.arxiv_id, r.page_no, r.ordinal) for r in scans.fold_ocr(df, "manifest", "response").collect()]
    assert out == [("a", 3, 1), ("a", 3, 3)]


def test_logistic_probe_minimises_the_usual_objective(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 150)
    x = rng.normal(size=(150, 4)) + np.eye(3, 4)[y] * 2
    rows = [(int(a), b.tolist()) for a, b in zip(y, x)]
    df = spark.createDataFrame(rows, "y int, v array<double>").repartition(2)
    model = models.fit_logistic(df, "v", "y", max_iter=300, k=3)
    w = len(y) / (3 * np.bincount(y))[y]
    def loss(coef, bias):
        z = x @ coef.T + bias
        z = z - np.log(np.exp(z).sum(1, keepdims=True))
        return -(w * z[np.arange(len(y)), y]).sum() + (coef ** 2).sum() / 2
    coef, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    best = loss(coef, bias)
    for _ in range(50):
        assert loss(coef + rng.normal(size=coef.shape) * 0.02, bias) >= best - 1e-4
    scored = models.predicted(model, df, "v", "y")
    assert scored.filter(F.col("pred4") == F.col("y")).count() > 110


def test_label_issues_follow_class_thresholds(spark):
    df = spark.createDataFrame(
        [(0, [0.9, 0.1]), (0, [0.7, 0.3]), (1, [0.1, 0.9]), (1, [0.6, 0.4]), (1, [0.95, 0.05])], "y int, p array<double>"
    )
    # mean self-confidence: class 0 0.8, class 1 0.45
    sure = [r.issue for r in models.label_issues(df, "y", "p", True).collect()]
    wide = [r.issue for r in models.label_issues(df, "y", "p", False).collect()]
    assert sure == [False, False, False, False, True] and wide == [False, False, False, True, True]


def test_gallery_documents_hold_every_uploaded_crop_in_order(spark):
    images = storage.gallery_images(spark, FOLDER)
    docs = [json.loads(r.doc) for r in stores.gallery_document(images, "b", 10, {"en": "E"}, 5, size=3000).orderBy("piece").collect()]
    lines = [json.loads(r.line) for r in stores.gallery_lines(images).orderBy("category", "name").collect()]
    assert len(docs) > 2 and [x for d in docs for x in d["images"]] == lines
    assert {tuple(d) for d in docs} == {("base", "display", "start", "target", "count", "updated_epoch", "images")}
    assert all((d["target"], d["start"], d["display"]) == (10, 5.0, {"en": "E"}) for d in docs)
    assert all(d["updated_epoch"] > 1_700_000_000 for d in docs)


def _tree(lines, size, fan):
    cut, seen = {}, 0
    for line in lines:
        cut.setdefault(seen // size, []).append(line)
        seen += len(line.encode())
    level = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in cut.items()}
    while max(level) > 0:
        up = {}
        for k in sorted(level):
            up[k // fan] = up.get(k // fan, "") + level[k]
        level = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in up.items()}
    return level[0], len(lines), len(cut)


@pytest.mark.parametrize("parts", [1, 7])
def test_hash_tree_follows_from_the_lines_alone(spark, parts):
    rows = [(i, "é" * (i * 37 % 11) + ("x" * 500 if i == 20 else "")) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, line string").repartition(parts)
    got = pieces.digest(pieces.numbered(df, ["k"], "line", 64), "line", 4).first()
    assert tuple(got) == _tree([x for _, x in rows], 64, 4)
    changed = df.withColumn("line", F.expr("CASE k WHEN 7 THEN 'other' ELSE line END"))
    assert pieces.digest(pieces.numbered(changed, ["k"], "line", 64), "line", 4).first().root != got.root


def test_hash_tree_of_nothing_and_of_null_lines(spark):
    for rows, want in (([], 0), ([(1, None)], 0), ([(1, None), (2, "")], 1)):
        df = spark.createDataFrame(rows, "k long, line string")
        got = pieces.digest(pieces.numbered(df, ["k"], "line"), "line").first()
        assert tuple(got) == (hashlib.sha256(b"").hexdigest(), want, want)


def test_archives_are_laid_out_by_field_and_batch(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 7), ("a", 2, 8), ("b", 1, 9)], "field string, batch int, id int")
    path = str(tmp_path / "z")
    stores.write_archives(df, path)
    assert spark.read.parquet(path).filter("field = 'a' AND batch = 2").first().id == 8


def test_recognised_texts_are_not_shuffled(spark):
    plan = registered.QUERIES["reg12_fold_ocr"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString()

from figureyard.operators.extract import extract_rows


def test_failing_documents_become_error_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, "c")], "k long, text string")

    def words(doc):
        if not doc["text"]:
            raise ValueError("empty")
        for i, w in enumerate(doc["text"].split()):
            yield {"i": i, "w": w}

    good, bad = extract_rows(df, "k", words, "i int, w string")
    assert sorted(tuple(r) for r in good.collect()) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "c")]
    assert [tuple(r) for r in bad.collect()] == [(2, "ValueError: empty")]


def test_documents_come_a_few_at_a_time(spark):
    df = spark.range(0, 2000, 1, 1).selectExpr("id AS k", "IF(id % 2 = 0, id, NULL) AS n")

    def seen(doc):
        yield {"n": doc["n"], "kind": type(doc["n"]).__name__}

    good, bad = extract_rows(df, "k", seen, "n long, kind string")
    assert bad.isEmpty()
    # nulls stay nulls and numbers whole, which a table of a whole batch does not give
    assert {(r.n, r.kind) for r in good.filter("k < 4").collect()} == {(0, "int"), (2, "int"), (None, "NoneType")}
    assert good.count() == 2000

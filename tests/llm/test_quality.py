from figureyard.llm import quality

GOOD = "This line says something plain and ends well. " * 12


def judged(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in quality.measures(df).collect()}


def test_counts(spark):
    r = judged(spark, "a b c a b c\nx\nx\n\n a$ |b|")[0]
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (10, 13, 3, 1)
    assert r.n_repeat_words == 6  # both "a b c" windows
    assert r.base_failed and not r.kept


def test_lines_go_first(spark):
    text = GOOD + "\nHome | News | About | More\nAll rights reserved.\nbuy!! now!! cheap!!"
    df = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    # repeated sentences fail the base rule, so vary them
    varied = " ".join(f"Sentence number {i} speaks of thing {i * 7}." for i in range(30))
    df = spark.createDataFrame([(1, varied + text[len(GOOD):], 0)], df.schema)
    (row,) = quality.clean(df).collect()
    assert row.text == varied and row.n_chars == len(varied)


def test_document_losing_too_much_goes(spark):
    nav = "\n".join(f"a{i} | b{i} | c{i} | d{i}" for i in range(40))
    fine = " ".join(f"Word{i} stands here." for i in range(10))
    r = judged(spark, nav + "\n" + fine)[0]
    assert not r.base_failed and not r.kept and r.n_kept_words == 30


def test_odd_rows(odd_docs, no_docs):
    rows = quality.measures(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].n_words == by[3].n_words == by[5].n_words == 0 and not by[2].kept
    assert by[4].n_words == 24000 and by[4].n_repeat_words == 24000 and by[4].base_failed
    assert quality.measures(no_docs).count() == 0
    assert quality.clean(odd_docs).columns == odd_docs.columns


def test_clean_judges_lines_once(spark, small_docs):
    plan = quality.clean(small_docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("all rights reserved") == 1 and plan.count("xxhash64") == 1


def test_repeats_counted_roughly_give_the_same_verdicts(spark, small_docs):
    texts = []
    for again in range(0, 40, 2):  # windows said twice or many times, up to over half of the words
        words = [f"w{i}" for i in range(60)]
        texts += [" ".join(words + words[:again] * n) for n in (1, 2, 5)]
    df = spark.createDataFrame([(-i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df = df.union(small_docs.select("doc_id", "text"))
    columns = ["doc_id", "n_words", "base_failed", "kept", "n_repeat_words"]
    exact, rough = (
        sorted(map(tuple, quality.measures(df, exact=e).select(columns).collect())) for e in (True, False)
    )
    assert [r[:4] for r in exact] == [r[:4] for r in rough]
    assert {r[2] for r in exact} == {True, False}
    assert any(a[4] > b[4] == 0 for a, b in zip(exact, rough))

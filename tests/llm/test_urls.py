from figureyard.llm import urls

PAGES = [
    (1, "http://WWW.Example.com/en/x?a#b", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    (2, "https://blog.example.com/en/", "blog.example.com", "/en/", "example.com/en/", "block"),
    (3, "https://blog.example.com/de/", "blog.example.com", "/de/", "com/", "allow"),
    (4, "https://a.net/fr/1", "a.net", "/fr/1", "net/fr/", "block"),
    (5, "https://anet/fr/1", "anet", "/fr/1", None, None),
    (6, "https://x.com", "x.com", "", None, None),
    (7, "no scheme", "", "", None, None),
    (8, None, "", "", None, None),
    (9, "", "", "", None, None),
    (10, "a://b://c/d", "b:", "//c/d", None, None),
    (11, "http://x.com\n/y", "x.com\n", "/y", None, None),
]


def test_rules(spark):
    df = spark.createDataFrame([p[:2] + ("h",) for p in PAGES], "page_id long, url string, host string")
    by = {r.page_id: r for r in urls.judged(df).collect()}
    for i, _, host, path, rule, verdict in PAGES:
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule)
        assert by[i].verdict in ("allow", "block") and verdict in (None, by[i].verdict)
    assert by[8].verdict == by[9].verdict == "allow" and by[8].score == 0


def test_model_tells_like_from_unlike(spark):
    rows = [(i, f"https://site{i}.com/news/{i}") for i in range(200)]
    rows += [(1000 + i, f"https://bets{i}.net/es/casino-{i}") for i in range(200)]
    rows += [(5000, "https://site9.org/news/7"), (5001, "https://bets3.org/es/casino-4")]
    rows.append(rows[0])
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert by[5000].verdict == "allow" and by[5001].verdict == "block"
    assert by[5000].decided_by == "model"


def test_no_rows(spark):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0

import hashlib
import re

from figureyard.llm import pii


def brute(text):
    """The contract's patterns as they are written."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        odd = sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])
        if 12 <= len(d) <= 19 and odd % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


TEXTS = [
    "a@b.co x@y@z.com a.b+c@d-e.f.gh. @no.com q@no", "a@b a@b.c@d.e", "1.2.3.4 256.1.1.1 1.2.3.4.5 01.002.3.4",
    "4539 1488 0343 6467 and 4539148803436467 or 4539148803436468", "+1 (017) 555-7713 +12 +49.30-1234567 (8)",
    "+1234567890123456", "x" * 5000 + "@" + "y" * 5000 + ".zz", "1" * 5000, "1." * 3000, "@" * 3000, "é@b.co ü+49 123 456 78",
]


def test_base_spans():
    for t in TEXTS:
        assert pii.entities(t) == brute(t), t[:60]


def test_spans_of_documents(small_docs):
    for r in small_docs.collect():
        assert pii.entities(r.text) == brute(r.text)


def told(spark):
    """An address that a rare name goes with in many contexts, and its decoys."""
    rows = []
    for i in range(6):
        rows.append((i, f"Write w{i} to zorblatt n{i} zed@mail.example.com v{i} today about item {i}."))
    rows += [(100 + i, f"Many plain words about item {i} without any address, today.") for i in range(60)]
    rows.append((500, "Only (Zorblatt) is named here."))
    return spark.createDataFrame([r + ("x",) for r in rows], "doc_id long, text string, n_chars string").drop("n_chars")


def test_disclosing_terms(spark):
    rows = {r.doc_id: r for r in pii.marked(told(spark)).collect()}
    terms = lambda i: [(s.s, s.e) for s in rows[i].spans if s.k == 4]
    at = "Only (Zorblatt) is named here.".index("Zorblatt")
    assert (at, at + 8) in terms(500)
    assert not any(terms(100 + i) for i in range(60))
    assert rows[0].n_email == 1 and len(rows[0].base) == 1


def test_sanitised(spark):
    df = told(spark)
    by = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert by[500] == "Only (<TERM>) is named here."
    assert "<EMAIL>" in by[3] and "zed@" not in by[3]
    assert by[130] == {r.doc_id: r.text for r in df.collect()}[130]


def test_odd_rows(odd_docs, no_docs):
    rows = pii.marked(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(r.base for r in rows)
    assert pii.marked(no_docs).count() == 0
    out = pii.sanitised(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()


def test_digests(spark):
    from figureyard.llm import registered

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in registered.QUERIES["op8_disclosing_terms"](spark, folder).collect():
        want = pii.written(brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))


def test_rare_entities_are_disclosed(spark):
    """An address in one place, and one in many texts of the same template."""
    rows = [(0, "The desk of Quillfeather (rare@one.example.com) is on this floor.")]
    rows += [(i, f"Note {i} Email: same@two.example.com Phone: none by Vornaskel here") for i in range(1, 9)]
    rows += [(100 + i, f"The desk is on this floor here, Email: none{i} Phone: none by hand {i}.") for i in range(200)]
    df = spark.createDataFrame([r + ("x",) for r in rows], "doc_id long, text string, n_chars string").drop("n_chars")
    out = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert "Quillfeather" not in out[0]
    assert not any("Vornaskel" in out[i] for i in range(1, 9))
    assert all("<" not in out[100 + i] for i in range(200))


def test_words_are_walked_whole():
    long = "z" * 900
    text = f"Quillfeather {long} a@b.co {long} Vornaskel"
    assert {t for _, t in pii.near_entities(text)} == {"quillfeather", "vornaskel", long}


def test_coded_terms_are_those_of_single_words(small_docs, odd_docs):
    texts = [r.text for r in small_docs.select("text").union(odd_docs.select("text")).collect()]
    texts += TEXTS + ["İstanbul, ΑΣ. 'ΣΑ' ΑΣ́. K9s a.b. (x) ... 12345 q@no wide\x85next\x1cone Kelvin ²³¹ ab"]
    terms, coded = pii.coded_terms(texts)
    names = terms.to_pylist()
    for text, held in zip(texts, coded):
        words = (text or "").split()
        assert [names[i] for i in held] == [pii.term(w) for w in words]
    every = bytes([255]) * (pii.BITS // 8)
    assert pii.passing(terms, every).tolist() == [t is not None for t in names]
    assert not pii.passing(terms, bytes(pii.BITS // 8)).any()
    assert pii.coded_terms([])[1] == []

import hashlib

import numpy as np

from figureyard.llm import fingerprint as fp

A = ["First paragraph.", "Second one is a little longer than the first. It goes on.", "Third."]


def test_order_does_not_matter_and_paragraphs_come_and_go():
    whole = fp.fingerprint("\n".join(A))
    assert (whole == fp.fingerprint("\n".join(reversed(A)))).all()
    assert (fp.inserted(fp.fingerprint("\n".join(A[:2])), A[2]) == whole).all()
    assert (fp.deleted(whole, A[2]) == fp.fingerprint("\n".join(A[:2]))).all()
    assert (fp.fingerprint("\n".join(A + A[2:])) != whole).any()
    assert (fp.fingerprint(" ".join(A)) != whole).any()
    assert fp.likeness(whole, whole) == 1 and fp.likeness(whole, np.zeros_like(whole)) == 0


def check(df):
    rows = sorted(
        ((r.doc_id, r.text or "") for r in df.collect()),
        key=lambda r: (-1 if r[0] is None else r[0]),
    )
    got = sorted(
        ((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next)
         for r in fp.with_next(df).collect()), key=repr)
    want = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        a, b, c = fp.fingerprint(t), fp.fingerprint(e), fp.fingerprint(following)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.shown(a), fp.likeness(a, b), fp.likeness(a, c)))
    assert got == sorted(want, key=repr)


def test_next_documents(small_docs):
    check(small_docs.select("doc_id", "text"))


def test_odd_rows(spark, odd_docs, no_docs):
    check(odd_docs)
    assert fp.with_next(no_docs).count() == 0
    check(spark.createDataFrame([(5, "alone")], "doc_id long, text string"))

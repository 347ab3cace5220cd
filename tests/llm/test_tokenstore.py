from collections import defaultdict

import numpy as np
import pytest

from figureyard.llm import tokenstore as ts
from figureyard.session import shared_path


@pytest.mark.parametrize("count", [1, 2, 3, 5, 64, 1000, 4097])
def test_slots_are_a_permutation(count):
    s = ts.slots(np.arange(count), count, 7)
    assert sorted(s.tolist()) == list(range(count))
    assert count < 64 or (s != np.arange(count)).mean() > 0.9
    assert count < 64 or (s != ts.slots(np.arange(count), count, 8)).any()


def stored(spark, df, length=64, records=50):
    folder = "file://" + shared_path(spark, "order")
    rows = ts.materialise(ts.sequences(df, length), folder, length, records).collect()
    return folder, sorted(rows, key=lambda r: r.slot)


def test_files_give_back_every_text(spark, small_docs):
    folder, rows = stored(spark, small_docs)
    assert [r.slot for r in rows] == list(range(len(rows)))
    back = list(ts.read_from(folder, 64, 50, 0, len(rows)))
    assert [(r.doc_id, r.start, r.length) for r in rows] == [(d, s, len(x)) for d, s, x in back]
    texts = defaultdict(dict)
    for d, s, x in back:
        texts[d][s] = x
    for r in small_docs.collect():
        assert b"".join(x for _, x in sorted(texts[r.doc_id].items())) == r.text.encode()
    # any slot may be the first one read
    assert list(ts.read_from(folder, 64, 50, 137, 90)) == back[137:227]


def test_reruns_agree(spark, small_docs):
    one, two = stored(spark, small_docs)[1], stored(spark, small_docs)[1]
    assert one == two


def test_odd_rows(spark, odd_docs, no_docs):
    folder, rows = stored(spark, odd_docs)
    back = list(ts.read_from(folder, 64, 50, 0, len(rows)))
    assert sum(len(x) for _, _, x in back) == sum(len((r.text or "").encode()) for r in odd_docs.collect())
    assert any(d is None for d, _, _ in back)
    assert stored(spark, no_docs)[1] == []


def test_query_stores_token_ids(spark):
    from figureyard.llm import registered
    from figureyard.llm.tokens import WordIds, public_file

    folder = "/root/testdata/sf0.001"
    made = []
    keep, ts.shared_path = ts.shared_path, lambda *a: made.append(keep(*a)) or made[-1]
    try:
        rows = registered.QUERIES["op5_training_order"](spark, folder).collect()
    finally:
        ts.shared_path = keep
    target = made[-1] if "://" in made[-1] or made[-1].startswith("file:") else f"file://{made[-1]}"
    back = list(ts.read_from(target, 2048, 8192, 0, len(rows), 2))
    assert len(back) == len(rows)
    ids = WordIds(public_file("word_bpe_49k.json"))
    texts = defaultdict(dict)
    for d, s, x in back:
        texts[d][s] = x
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        want = np.frombuffer(ids.text(r.text), "<u4").tolist()
        got = np.frombuffer(b"".join(x for _, x in sorted(texts[r.doc_id].items())), "<u2").tolist()
        assert got == want


def test_part_ids_are_the_word_ids(odd_docs):
    from figureyard.llm.tokens import BlockIds, PartIds, WordIds, public_file

    path = public_file("word_bpe_49k.json")
    one, two = WordIds(path), PartIds(path)
    texts = [r.text for r in odd_docs.collect()] + [
        "Plain words, (marks) 2024-10!", "ÀÉß ÿ straße\tx\n\x0by\x0cz\r\n", "it's not", "a\x1cb", " ", "<|endoftext|> [x]", "naïve—dash", "e\u0301", "×÷ a_b"
    ]
    for text in texts:
        assert b"".join(two.ids(text)) == one.text(text) == (one.slowly(text) if text else b""), text
    many = [*texts, "Long words 12, here. " * 60_000, "x" * (1 << 20) + " y", None, ""]
    three = BlockIds(path)
    for _ in range(2):
        for text, ids, n in zip(many, three.arrays(many), three.numbers(many)):
            assert ids.astype("<u4").tobytes() == one.text(text) and n == len(ids)


def test_token_sequences_of_odd_rows(odd_docs, no_docs):
    from figureyard.llm.tokens import public_file

    path = public_file("word_bpe_49k.json")
    for df in (odd_docs, no_docs):
        n = sum(r["count"] for r in ts.token_sequence_counts(df, 8, path).collect())
        assert n == ts.token_sequences(df, 8, path).count()


def test_parts_that_share_a_place_keep_their_ids(monkeypatch):
    from figureyard.llm import tokens

    monkeypatch.setattr(tokens, "NEAR", 4)
    monkeypatch.setattr(tokens, "KNOWN_PARTS", 40)
    path = tokens.public_file("word_bpe_49k.json")
    texts = [" ".join(f"word{chr(97 + i * k % 26)}{i}, {k}" for i in range(30)) for k in range(1, 9)]
    coder, plain = tokens.BlockIds(path), tokens.WordIds(path)
    want = [np.frombuffer(plain.text(t), "<u4").tolist() for t in texts]
    for _ in range(2):
        for at in range(0, len(texts), 3):
            part = texts[at : at + 3]
            assert [x.tolist() for x in coder.arrays(part)] == want[at : at + 3]
            assert coder.numbers(part).tolist() == [len(x) for x in want[at : at + 3]]

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from figureyard.llm import packing
from figureyard.llm.tokens import WordIds, public_file

FILE = public_file("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


def test_ids_are_the_librarys():
    t, ids = library(), WordIds(FILE)
    texts = [
        "Plain words, and MORE words!", "It's don't we'll I'd", "naïve Straße ÀÉÎ ΣΑΣ İstanbul",
        "e\u0301 combining", "漢字 かな 🙂🙃", "a\x1cb \x85 \xa0 c\u2003d", "<|endoftext|> x<|startoftext|>",
        "3.14 1,000 x2y3", "", "   ", "ÿþ \u00ad soft", "@#$%^&*()_+{}|:\"<>?`-=[];',./", "ﬁ ligature Ǆ",
    ]
    for x in texts:
        want = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(ids.text(x), "<u4").tolist() == want, x


def check(df):
    rows = packing.pack(df, FILE).collect()
    t = library()
    want = sorted(
        ((r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in df.collect()), key=repr
    )
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i in {w[0] for w in want}:
        own = [ids for d, ids in want if d == i]
        # each id lies in exactly one piece, also of rows that share an id
        assert sum(r.length for r in pieces[i]) == sum(map(len, own))
        for r in pieces[i]:
            assert r.doc_tokens in {len(x) for x in own}
            crcs = {zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in own}
            assert r.ids_crc32 in crcs and r.length > 0
    padding = total = 0
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at
            at += r.length
        size = at if at & (at - 1) == 0 else 2048
        assert at <= 2048 and {r.padded_to for r in s} == {size}
        padding, total = padding + size - at, total + size
    return padding, total, rows


def test_pieces(small_docs):
    df = small_docs.coalesce(1)
    padding, total, rows = check(df)
    assert padding <= 2048
    steps = defaultdict(dict)
    for r in rows:
        steps[r.step_id][r.sequence_id] = r.padded_to
    full = [sum(s.values()) for s in steps.values()]
    assert max(full) <= packing.STEP_TOKENS and sorted(full)[1:][0] >= packing.STEP_TOKENS - 2048
    assert {r.window for r in rows} == {256, 512, 1024, 2048}


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs.repartition(2))
    assert packing.pack(no_docs, FILE).count() == 0


def test_plain_texts_need_no_library(small_docs):
    from figureyard.llm.tokens import BlockIds

    texts = [r.text for r in small_docs.limit(100).collect()]
    coder, words = BlockIds(FILE), WordIds(FILE)
    assert [a.astype("<u4").tobytes() for a in coder.arrays(texts)] == [words.text(t) for t in texts]
    plain = BlockIds(FILE)
    plain.arrays(["Plain words, 12 of them."])
    assert "whole" not in vars(plain)
    plain.arrays(["漢字"])
    assert "whole" in vars(plain)

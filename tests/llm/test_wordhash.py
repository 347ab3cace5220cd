import random

import numpy as np
import pytest

from figureyard.llm import wordhash
from figureyard.llm.common import alnum_words
from figureyard.llm.wordhash import word_hashes


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_equal_words_have_equal_hashes_and_others_differ(monkeypatch, block):
    monkeypatch.setattr(wordhash, "BLOCK", block)
    r = random.Random(block)
    texts = ["".join(r.choice("abAB1 é漢_-\n") for _ in range(r.randint(0, 90))) for _ in range(200)]
    texts += [None, "", "  ", "x" * 3_000_000, " y", "z "]
    h, sizes = word_hashes(texts)
    words = [w for t in texts for w in alnum_words(t)]
    assert sizes.tolist() == [len(alnum_words(t)) for t in texts] and len(h) == len(words)
    known = {}
    assert all(known.setdefault(w, x) == x for w, x in zip(words, h.tolist()))
    assert len(set(known.values())) == len(known)
    assert [len(v) for v in word_hashes([])] == [0, 0]
    assert h.dtype == np.uint64

"""Token ids of texts by a public tokenizer file, as little-endian bytes.

Ids are those of the ``tokenizers`` library. A text is cut at white space and
each distinct piece is encoded once and remembered, which is exact because the
file's pre-tokenizer never joins across white space. Pieces of plain letters go
through ``tiktoken``'s byte-pair merges with the same ranks, all others through
the library itself.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property
from pathlib import Path

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

from figureyard.llm import wordhash

KNOWN = 300_000  # remembered pieces in a task
KNOWN_PARTS = 600_000  # remembered parts in a worker
# Letters that lower-casing and composition treat one by one, and ASCII marks.
PLAIN = regex.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~0-9]+")
PARTS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# Texts of such characters and white space, and their parts in lower case.
PLAIN_TEXT = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~0-9 \t\n\v\f\r]+")
PLAIN_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
# str.split() takes these as white space, the tokenizer does not.
ODD_SPACES = regex.compile(r"[\x1c-\x1f]")
WORD_END = b"\xff"  # never part of UTF-8


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable
    Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds(dict):
    """Piece of text without white space -> its ids as bytes of uint32."""

    def __init__(self, path: str):
        self.path = path
        letters, end = byte_letters(), "</w>"
        ranks = {}
        for token, rank in json.loads(Path(path).read_text("utf-8"))["model"]["vocab"].items():
            body = token.removesuffix(end)
            ranks[bytes(letters[c] for c in body) + WORD_END * (body != token)] = rank
        coder = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        self.merge = coder._core_bpe.encode_single_piece

    @cached_property
    def whole(self) -> Tokenizer:
        """The library's own, which plain texts never need."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def slowly(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if PLAIN.fullmatch(piece):
            ids = []
            for part in PARTS.findall(unicodedata.normalize("NFC", piece).lower()):
                ids += self.merge(part.encode() + WORD_END)
            value = np.array(ids, "<u4").tobytes()
        else:
            value = self.slowly(piece)
        if len(self) >= KNOWN:
            self.clear()
        self[piece] = value
        return value

    def text(self, text: str | None) -> bytes:
        text = text or ""
        if ODD_SPACES.search(text):
            return self.slowly(text)
        return b"".join(map(self.__getitem__, text.split()))


class PartIds(WordIds):
    """The same ids, looked up by run of letters or marks where a whole text is
    plain: lower-cased runs are far fewer than pieces."""

    def __init__(self, path: str):
        super().__init__(path)
        self.parts: dict[str, bytes] = {}

    def ids(self, text: str | None) -> list[bytes]:
        """Ids of ``text`` as bytes of uint32, in parts that follow each other."""
        text = text or ""
        if not PLAIN_TEXT.fullmatch(text):
            return [self.text(text)]
        parts, known = PLAIN_PARTS.findall(text.lower()), self.parts
        try:
            return [known[p] for p in parts]
        except KeyError:
            if len(known) > KNOWN_PARTS:
                known.clear()
            for p in {p for p in parts if p not in known}:
                known[p] = np.array(self.merge(p.encode() + WORD_END), "<u4").tobytes()
            return [known[p] for p in parts]


# Kinds of the Latin-1 bytes of a plain lower-cased text: white space, letters,
# digits (each a part of its own), marks.
KINDS = np.array([1 if chr(b).isalpha() else 2 if 48 <= b < 58 else 0 if b in b" \t\n\v\f\r" else 3 for b in range(256)], np.uint8)
CUT = 1 << 20  # bytes handled together, if no part is longer
NEAR = 1 << 19  # places by low bits of a hash, a power of two


def part_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end) of every part of a plain text as Latin-1 bytes."""
    x = np.frombuffer(data, np.uint8)
    kind = KINDS[x]
    before = np.r_[np.uint8(0), kind[:-1]]
    begin = np.flatnonzero((kind != 0) & ((kind != before) | (kind == 2)))
    stops = np.flatnonzero((kind != before) | (kind == 2))
    end = np.r_[stops, len(x)][np.searchsorted(stops, begin) + 1]
    return wordhash.of_ranges(x, begin, end), begin, end


class BlockIds(PartIds):
    """The same ids for many texts at once: parts are hashed in blocks (64 bits keep
    them apart), and ids are gathered by numpy. Most parts are found at the place of
    their hash's low bits, which holds the last part that was looked up there; each
    distinct other one of a block is looked up once."""

    def __init__(self, path: str):
        super().__init__(path)
        self.flat, self.cuts = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.forget()

    def forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.used = 0
        # a place starts with a number that never belongs there
        self.near, self.near_slot = np.arange(NEAR, dtype=np.uint64) ^ np.uint64(1), np.zeros(NEAR, np.int32)

    def learn(self, parts: list[bytes], hashes: list[int]) -> None:
        lists = [self.merge(p.decode("latin-1").encode() + WORD_END) for p in parts]
        n, total = len(self.slots), self.used + sum(map(len, lists))
        while len(self.cuts) <= n + len(parts):
            self.cuts = np.r_[self.cuts, np.zeros_like(self.cuts)]
        while len(self.flat) < total:
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.flat[self.used : total] = np.fromiter((i for ids in lists for i in ids), np.uint32, total - self.used)
        self.cuts[n + 1 : n + 1 + len(parts)] = self.used + np.cumsum([len(ids) for ids in lists])
        self.slots.update(zip(hashes, range(n, n + len(parts))))
        self.used = total

    def found(self, hashes: np.ndarray, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Slot of every part."""
        at = (hashes & np.uint64(NEAR - 1)).astype(np.int64)
        slot = self.near_slot[at]
        other = np.flatnonzero(self.near[at] != hashes)
        if not len(other):
            return slot
        distinct, first, inverse = np.unique(hashes[other], return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if self.slots and len(self.slots) + len(keys) > KNOWN_PARTS:
            self.forget()
            return self.found(hashes, data, begin, end)
        new = [i for i, k in enumerate(keys) if k not in self.slots]
        if new:
            where = other[first[new]]
            self.learn([data[a:b] for a, b in zip(begin[where].tolist(), end[where].tolist())], [keys[i] for i in new])
        looked_up = np.fromiter(map(self.slots.__getitem__, keys), np.int32, len(keys))
        slot[other] = looked_up[inverse]
        place, last = np.unique(at[other][first], return_index=True)
        self.near[place], self.near_slot[place] = distinct[last], looked_up[last]
        return slot

    def block(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, number of ids, begin) of every part of ``data``."""
        hashes, begin, end = part_hashes(data)
        slot = self.found(hashes, data, begin, end)
        return slot, self.cuts[slot + 1] - self.cuts[slot], begin

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray | None, np.ndarray]]:
        """(place of the text, slots or None, ids or their numbers) piece by piece:
        with slots for plain texts, else the ids themselves."""
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            text = text or ""
            if not PLAIN_TEXT.fullmatch(text):
                if text:
                    yield i, None, np.frombuffer(self.text(text), "<u4")
                continue
            data = text.lower().encode("latin-1")
            while len(data) > CUT:
                cut = max(data.rfind(c, 0, CUT) for c in (b" ", b"\n", b"\t"))
                if cut <= 0:
                    break
                yield from self.pieces([(i, data[:cut])])
                data = data[cut:]
            if size + len(data) > CUT and held:
                yield from self.pieces(held)
                held, size = [], 0
            held.append((i, data))
            size += len(data) + 1
        if held:
            yield from self.pieces(held)

    def pieces(self, held: list[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        slot, n, begin = self.block(b" ".join(d for _, d in held))
        edges = np.searchsorted(begin, np.cumsum([0, *(len(d) + 1 for _, d in held)]))
        for (i, _), a, b in zip(held, edges, edges[1:]):
            yield i, slot[a:b], n[a:b]

    def numbers(self, texts: list[str | None]) -> np.ndarray:
        """How many ids each text has."""
        out = np.zeros(len(texts), np.int64)
        for i, slot, n in self.blocks(texts):
            out[i] += len(n) if slot is None else int(n.sum())
        return out

    def arrays(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for i, slot, n in self.blocks(texts):
            if slot is not None:
                at = np.repeat(self.cuts[slot] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                n = self.flat[at]
            parts[i].append(n)
        return [np.concatenate([*p, np.empty(0, np.uint32)]) for p in parts]


@cache
def block_ids(path: str) -> BlockIds:
    """One for each file and process."""
    return BlockIds(path)


@cache
def part_ids(path: str) -> PartIds:
    """One for each file and process, so that tasks that follow each other in a
    worker keep the parts."""
    return PartIds(path)


def public_file(name: str) -> str:
    return public_tokenizers.path(name)

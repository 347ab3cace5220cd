"""Hierarchical packing of documents into windows of several lengths.

A document of T tokens is routed to tiers: pieces of the longest window first,
then the rest to the smallest window that holds it. Each tier is packed by
itself; a window that a piece does not fill takes whole pieces of shorter tiers,
the longest that fit, and at last a cut piece, so that all but a buffer's last
windows are full. Windows are the powers of two from ``SHORTEST`` to
``LONGEST``; a sequence that ends short of its window is padded to the longest.
Steps group windows of all lengths to the same number of tokens.

Each task packs its own rows, a bounded buffer of documents at a time: no
shuffle, nothing global. Padding is at most one window for each task.
Sequences are named by task and count.

A null or empty text is the closing id alone. Repeated rows and rows with the
same doc_id are packed each; extra columns are ignored; an empty table gives no
piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from figureyard.llm.common import table
from figureyard.llm.tokens import BlockIds, public_file

LONGEST, SHORTEST = 2048, 256
CLOSING_ID = 1
STEP_TOKENS = 32 * LONGEST
BUFFER_TOKENS = 512 * LONGEST  # of pieces that wait in a task

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, window long, padded_to long, step_id long"
)
ARROW = pa.schema(
    [(f.split()[0], pa.int64()) for f in PIECES.split(", ")]
)


class Packer:
    """Pieces of one task. A piece is (length, number, start); numbers index
    ``docs``, which holds (doc_id, ids as bytes, tokens) until they are packed."""

    def __init__(self, task: int):
        self.base, self.sequences, self.steps = task << 40, 0, 0
        self.room = 0
        self.waiting: list[tuple[int, int, int]] = []  # rests, by length
        self.docs: dict[int, tuple[int | None, bytes, int]] = {}
        self.left: dict[int, int] = {}  # tokens of a document not yet packed
        self.tokens, self.seen, self.out = 0, 0, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs[self.seen], self.left[self.seen] = (doc_id, ids, n), n
        whole = n - n % LONGEST
        for start in range(0, whole, LONGEST):
            self.close([(LONGEST, self.seen, start)], LONGEST)
        if n > whole:
            insort(self.waiting, (n - whole, self.seen, whole))
            self.tokens += n - whole
        self.seen += 1
        if self.tokens >= BUFFER_TOKENS:
            self.pack()

    def close(self, pieces: list[tuple[int, int, int]], window: int) -> None:
        """One sequence, and the step that it belongs to."""
        total = sum(p[0] for p in pieces)
        padded = total if total & (total - 1) == 0 else LONGEST
        if self.room < padded:
            self.steps, self.room = self.steps + 1, STEP_TOKENS
        self.room -= padded
        at = 0
        for length, number, start in pieces:
            doc_id, ids, n = self.docs[number]
            crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
            self.out.append(
                (doc_id, start, length, crc, n, self.base + self.sequences, at, window, padded,
                 self.base + self.steps - 1)
            )
            at += length
            self.left[number] -= length
            if not self.left[number]:
                del self.left[number], self.docs[number]
        self.sequences += 1

    def fitting(self, room: int) -> tuple[int, int, int] | None:
        """Take the longest waiting piece of at most ``room`` tokens."""
        at = bisect_right(self.waiting, (room, float("inf"), 0))
        if not at:
            return None
        return self.waiting.pop(at - 1)

    def pack(self) -> None:
        """Pack all waiting pieces, longest windows first."""
        while self.waiting:
            first = self.waiting.pop()
            window = max(SHORTEST, 1 << (first[0] - 1).bit_length())
            pieces, room = [first], window - first[0]
            while room and (piece := self.fitting(room)):
                pieces.append(piece)
                room -= piece[0]
            if room and self.waiting:
                length, number, start = self.waiting.pop(0)  # the shortest, cut
                pieces.append((room, number, start))
                insort(self.waiting, (length - room, number, start + room))
            self.close(pieces, window)
        self.tokens = 0


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces (``PIECES``) of all documents; ``tokenizer`` is a file's path."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId())
        ids, closing = BlockIds(tokenizer), CLOSING_ID.to_bytes(4, "little")

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(v, pa.int64()) for v in zip(*packer.out)]
            packer.out = []
            return pa.RecordBatch.from_arrays(columns, schema=ARROW)

        for part in parts:
            for start in range(0, part.num_rows, 256):
                cut = part.slice(start, 256)
                texts = ids.arrays(cut.column("text").to_pylist())
                for i, text in zip(cut.column("doc_id").to_pylist(), texts):
                    packer.add(i, text.astype("<u4").tobytes() + closing)
                if packer.out:
                    yield flushed()
        packer.pack()
        if packer.out:
            yield flushed()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def query(spark, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_file("word_bpe_49k.json"))

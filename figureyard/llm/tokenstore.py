"""Training-order materialisation: sequences of ids in shuffled order, as files.

Sequences of a fixed number of ids are counted, and a keyed Feistel permutation
of their numbers, walked along its cycle until it falls below the count, gives
each a slot of the global training order. Slots are cut into ranges, a file
each, of records of one size: slot s is record s % records of shard
s // records. A reader therefore reads sequentially, may start at any slot, and
needs no index.

Record: doc_id, start and length (little-endian 64, 64 and 32 bits), then the ids
padded with zeros. Start and length count ids. The ids of the query are those of
a sub-word vocabulary in 16 bits each (``token_sequences``); any width of
fixed-size ids may be given.

Numbers of sequences follow the input's partitions, so the plan that counts and
the plan that writes must cut the input alike. Each shard checks that it got
every slot of its range once, so a job whose input was cut differently in between
fails instead of writing a wrong order. Texts are encoded once to count their
sequences and again to write them, so no table of ids lies on disk. Files are written under a name of the
attempt and renamed, so a repeated task replaces its file by the same bytes.

Ids travel compressed, with some of the first sequences as a common dictionary
(``SAMPLED`` of them; they change sizes on the way, never results).

A text without ids (null, empty, white space alone) has no sequence; a null doc_id is written as the smallest
number. Repeated rows are stored each; extra columns are ignored; an empty table
writes nothing.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figureyard.llm.common import table
from figureyard.llm.tokens import block_ids, public_file
from figureyard.session import shared_path

HEAD = "<qqi"
HEAD_SIZE = struct.calcsize(HEAD)
NO_ID = -(1 << 63)
ROUNDS = 6
SAMPLED = 64
TOKENIZER, LENGTH = "word_bpe_49k.json", 1024
ID_SIZE = 2  # bytes of an id of a sub-word vocabulary
TEXTS = 256  # encoded together

def round_keys(key: int) -> np.ndarray:
    return np.random.default_rng(key).integers(1, 2**63, ROUNDS, dtype=np.uint64)


def scrambled(x: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Feistel network on numbers of ``bits`` bits (even)."""
    half = np.uint64(bits // 2)
    low = np.uint64((1 << (bits // 2)) - 1)
    left, right = x >> half, x & low
    for k in keys:
        f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
        f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        left, right = right, left ^ ((f >> np.uint64(32)) & low)
    return (left << half) | right


def slots(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """A permutation of 0..count-1: outside numbers are scrambled again."""
    bits = max(2, (max(1, count - 1)).bit_length())
    bits += bits % 2
    keys = round_keys(key)
    out = scrambled(numbers.astype(np.uint64), bits, keys)
    while (wrong := out >= np.uint64(count)).any():
        out[wrong] = scrambled(out[wrong], bits, keys)
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, start, ids: the text's bytes in pieces of ``length``."""
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    starts = F.sequence(F.lit(0), F.octet_length("data") - 1, F.lit(length))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"))
        .where(F.octet_length("data") > 0)
        .select("doc_id", "data", F.explode(starts).alias("start"))
        .select("doc_id", F.col("start").cast("long").alias("start"),
                F.substring(F.col("data"), F.col("start") + 1, F.lit(length)).alias("ids"))
    )


SEQUENCE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def token_sequences(docs: DataFrame, length: int, tokenizer: str) -> DataFrame:
    """doc_id, start, ids: the text's ids by the file ``tokenizer``, little-endian
    16 bits each, in pieces of ``length`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), SEQUENCE)], schema=SEQUENCE)
            found.clear()
            return out

        coder = block_ids(tokenizer)
        if coder.whole.get_vocab_size() > 1 << (8 * ID_SIZE):
            raise ValueError(f"the vocabulary of {tokenizer} does not fit {ID_SIZE} bytes")
        found: list[tuple] = []
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                for doc, ids in zip(part.column("doc_id").to_pylist(), coder.arrays(part.column("text").to_pylist())):
                    data = ids.astype("<u2").tobytes()
                    for start in range(0, len(ids), length):
                        found.append((doc, start, data[ID_SIZE * start : ID_SIZE * (start + length)]))
                        if len(found) >= 1024:
                            yield flushed()
        if found:
            yield flushed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, ids binary")


def token_sequence_counts(docs: DataFrame, length: int, tokenizer: str) -> DataFrame:
    """part, count: how many sequences each partition of ``token_sequences`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, coder = 0, block_ids(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                n += int((-(-coder.numbers(b.slice(at, TEXTS).column("text").to_pylist()) // length)).sum())
        if n:
            columns = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "count"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part long, count long")


RECORDS = (
    "doc_id long, start long, length long, slot long, shard long, offset long, ids_crc32 long"
)


def materialise(
    seqs: DataFrame, folder: str, width: int, records: int = 8192, key: int = 20240601,
    id_size: int = 1, counts: DataFrame | None = None,
) -> DataFrame:
    """Write ``seqs`` (doc_id, start, ids as bytes, at most ``width``) below
    ``folder`` and return ``RECORDS`` for every sequence. An id has ``id_size``
    bytes; ``counts`` (part, count) has the rows of each partition of ``seqs``
    where they are cheaper to have than by counting."""
    spark = seqs.sparkSession
    place = F.monotonically_increasing_id()
    part = F.shiftright(place, 33)
    if counts is None:
        counts = seqs.select(part.alias("part")).groupBy("part").count()
    sizes = counts.collect()
    # a number for each partition of the input
    before, count = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        before[r["part"]] = count
        count += r["count"]
    shards = max(1, -(-count // records))

    common = b"".join(bytes(r["ids"]) for r in seqs.select("ids").limit(SAMPLED).collect())

    def dictionary() -> zstandard.ZstdCompressionDict:
        return zstandard.ZstdCompressionDict(common, dict_type=zstandard.DICT_TYPE_RAWCONTENT)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6, dict_data=dictionary())
        for b in batches:
            at = b.column("at").to_numpy()
            starts = np.array([before.get(p, count) for p in (at >> 33).tolist()], np.int64)
            n = starts + (at & ((1 << 33) - 1))
            if (n >= count).any():
                raise RuntimeError("the input was cut differently since it was counted")
            slot = pa.array(slots(n, count, key), pa.int64())
            ids = pa.array([pack.compress(x) for x in b.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), ids, slot], names=["doc_id", "start", "ids", "slot"])

    numbered = seqs.withColumn("at", place).mapInArrow(number, "doc_id long, start long, ids binary, slot long")
    dealt = (
        numbered.withColumn("shard", F.floor(F.col("slot") / records))
        .repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")
    )
    stride = HEAD_SIZE + width
    out = pa.schema([(f.split()[0], pa.int64()) for f in RECORDS.split(", ")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base, sink, shard, due, name = None, "", None, -1, 0, ""
        unpack = zstandard.ZstdDecompressor(dict_data=dictionary())

        def finish() -> None:
            if sink is not None:
                sink.close()
                if due != min((shard + 1) * records, count):
                    raise RuntimeError(f"shard {shard} lacks slots from {due} on")
                system.move(name, shard_path(base, shard))

        for b in batches:
            if system is None:
                system, base = fs.FileSystem.from_uri(folder)
                system.create_dir(base, recursive=True)
            found = []
            for doc, start, ids, slot in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "ids", "slot"))):
                ids = unpack.decompress(ids)
                if slot // records != shard:
                    finish()
                    shard = slot // records
                    due, name = shard * records, f"{base}/.{shard}-{uuid.uuid4().hex}"
                    sink = system.open_output_stream(name)
                if slot != due:
                    raise RuntimeError(f"slot {due} is missing or there twice")
                sink.write(struct.pack(HEAD, NO_ID if doc is None else doc, start, len(ids) // id_size) + ids.ljust(width, b"\0"))
                found.append((doc, start, len(ids) // id_size, slot, shard, (slot - shard * records) * stride, zlib.crc32(ids)))
                due += 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found)], schema=out)
        finish()

    return dealt.select("doc_id", "start", "ids", "slot").mapInArrow(write, RECORDS)


def shard_path(base: str, shard: int) -> str:
    return f"{base}/shard-{shard:08d}.bin"


def read_from(folder: str, width: int, records: int, slot: int, count: int, id_size: int = 1) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, start, ids) of ``count`` slots from ``slot`` on, read in sequence."""
    system, base = fs.FileSystem.from_uri(folder)
    stride = HEAD_SIZE + width
    while count > 0:
        shard, at = divmod(slot, records)
        take = min(count, records - at)
        with system.open_input_file(shard_path(base, shard)) as f:
            f.seek(at * stride)
            data = f.read(take * stride)
        if not data:
            return
        for i in range(0, len(data), stride):
            doc, start, n = struct.unpack_from(HEAD, data, i)
            yield None if doc == NO_ID else doc, start, data[i + HEAD_SIZE : i + HEAD_SIZE + n * id_size]
        slot, count = slot + take, count - take


def query(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "training-order")
    target = path if "://" in path or path.startswith("file:") else f"file://{path}"
    docs, tokenizer = table(spark, folder, "documents"), public_file(TOKENIZER)
    return materialise(
        token_sequences(docs, LENGTH, tokenizer), target, LENGTH * ID_SIZE, id_size=ID_SIZE,
        counts=token_sequence_counts(docs, LENGTH, tokenizer),
    )

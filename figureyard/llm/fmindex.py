"""Benchmark decontamination by an FM-index for each shard of the documents.

``build`` cuts the documents into shards of a bounded number of words and writes
one row for each: the Burrows-Wheeler transform of its words as a wavelet matrix
(bits, a level for each bit of a word's number), and every ``EVERY``-th position
of each document with the suffixes it belongs to marked. Documents end in marks
that differ from each other, so no phrase crosses two documents and suffixes are
told apart at the end of a document at the latest. Words go by 64-bit hashes. A document longer than a shard
lies in several, which overlap by one word less than the longest phrase.

``search`` takes test phrases in blocks of bounded size, one pass over the index
for each: all phrases of a block go backwards through the ranks of the wavelet
matrix at once, those that occur are located by stepping back to the next sampled
position, and the words they cover are merged to spans. Spans and items of all
blocks and shards of a document meet in one aggregation by document.

A phrase is a window of ``WINDOW`` consecutive words of an item, or all words of a
shorter item; words are those of ``common.alnum_words``.

Null and empty texts, and texts without words, hold and are hit by nothing. Rows
that repeat count each, also where they share an id. Items that share an id are
one item; an item without id is called by the empty text. An empty table of items
hits nothing, one of documents gives an empty result. Extra columns are ignored by
``contamination`` and kept by ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figureyard.llm.common import Workspace, alnum_words, alnum_words_of, table
from figureyard.llm.wordhash import word_hashes

WINDOW = 10
SHARD = 1 << 18  # words
EVERY = 16  # positions for each sample
BLOCK_ROWS, BLOCK_BYTES = 100_000, 1 << 24  # phrases searched together
FOUND = 1 << 18  # occurrences located together

INDEX = pa.schema(
    [("keys", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64())),
     ("firsts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("vocabulary", pa.binary()),
     ("counts", pa.binary()), ("levels", pa.list_(pa.binary())), ("marks", pa.binary()), ("places", pa.binary())]
)
INDEX_DDL = (
    "keys array<long>, doc_ids array<long>, totals array<long>, firsts array<long>, lengths array<int>, "
    "vocabulary binary, counts binary, levels array<binary>, marks binary, places binary"
)


def suffix_order(x: np.ndarray, top: int) -> np.ndarray:
    """Suffixes of ``x`` in order. Zeros end a document; they are smaller than all
    words and ordered by their place. The last element is a zero; words are at
    most ``top``."""
    n = len(x)
    ends = np.flatnonzero(x == 0)
    left = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(n)  # words before the end
    bits = top.bit_length()
    h = max(1, min(n, 62 // bits))
    key = np.zeros(n, np.int64)
    for j in range(h):
        key <<= bits
        key[: n - j] |= np.where(left[: n - j] > j, x[j:], 0)
    order = np.argsort(key)
    key = key[order]
    single = left[order] < h  # ends within the key: told apart by its place
    which = np.flatnonzero(single)
    order[which] = order[which][np.lexsort((order[which], key[which]))]
    first = np.r_[True, key[1:] != key[:-1]] | single
    cls = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = cls
    at = np.flatnonzero(~(first & np.r_[first[1:], True]))
    while len(at):
        s = order[at]
        key = cls[at] * n + rank[s + h]
        o = np.argsort(key)
        order[at], key = s[o], key[o]
        first = np.r_[True, key[1:] != key[:-1]]
        cls[at] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        rank[order[at]] = cls[at]
        at = at[~(first & np.r_[first[1:], True])]
        h *= 2
    return order


def packed(bits: np.ndarray) -> bytes:
    data = np.packbits(bits, bitorder="little").tobytes()
    return data + b"\0" * (8 - len(data) % 8)  # a word more than full


class Bits:
    """Bits with the number of ones before any place."""

    def __init__(self, data: bytes):
        self.words = np.frombuffer(data, "<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def ones(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)


class Shard:
    """Ranks of the transformed words of one row of the index."""

    def __init__(self, counts: np.ndarray, levels: list[bytes], marks: bytes, places: np.ndarray):
        self.n = int(counts.sum())
        self.levels = [Bits(v) for v in levels]
        self.zeros = [self.n - int(v.before[-1]) for v in self.levels]
        self.start = np.r_[0, np.cumsum(counts)]  # of each word among the suffixes
        self.marks, self.places = Bits(marks), places
        # where each word begins below the last level: words by reversed bits
        words = np.arange(len(counts))
        turned = np.zeros_like(words)
        for b in range(len(levels)):
            turned |= ((words >> b) & 1) << (len(levels) - 1 - b)
        order = np.argsort(turned)
        self.begin = np.empty(len(counts), np.int64)
        self.begin[order] = np.r_[0, np.cumsum(counts[order])[:-1]]

    def before(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place among the suffixes of ``word`` followed by what is below place i."""
        for b, level, zeros in zip(range(len(self.levels) - 1, -1, -1), self.levels, self.zeros):
            ones = level.ones(i)
            i = np.where((word >> b) & 1 != 0, zeros + ones, i - ones)
        return self.start[word] + i - self.begin[word]

    def back(self, i: np.ndarray) -> np.ndarray:
        """Place of the suffix that is longer by a word."""
        word = np.zeros_like(i)
        for level, zeros in zip(self.levels, self.zeros):
            bit, ones = level.get(i), level.ones(i)
            word = (word << 1) | bit
            i = np.where(bit, zeros + ones, i - ones)
        return self.start[word] + i - self.begin[word]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) among the suffixes for each phrase; words are right-aligned,
        a zero is a word that the shard lacks."""
        low, high = np.zeros((2, len(phrases)), np.int64)
        width = phrases.shape[1]
        known = (phrases > 0).sum(1) == lengths
        live = np.flatnonzero(known & (lengths > 0))
        last = phrases[live, width - 1]
        low[live], high[live] = self.start[last], self.start[last + 1]
        for j in range(width - 2, -1, -1):
            live = live[(lengths[live] > width - 1 - j) & (low[live] < high[live])]
            if not len(live):
                break
            word = phrases[live, j]
            low[live], high[live] = self.before(word, low[live]), self.before(word, high[live])
        return low, np.maximum(low, high)

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Positions of suffixes."""
        out, at, steps = np.empty(len(i), np.int64), np.arange(len(i)), 0
        while len(i):
            sampled = self.marks.get(i)
            hit = i[sampled]
            out[at[sampled]] = self.places[self.marks.ones(hit)] + steps
            i, at, steps = self.back(i[~sampled]), at[~sampled], steps + 1
        return out


def built(x: np.ndarray, starts: np.ndarray, top: int) -> tuple[bytes, list[bytes], bytes, bytes]:
    """counts, levels, marks, places of the words ``x``; documents begin at ``starts``."""
    order = suffix_order(x, top)
    offset = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
    sampled = (offset % EVERY == 0)[order]
    bwt, levels = x[order - 1].astype(np.int32), []
    for b in range(top.bit_length() - 1, -1, -1):
        bit = (bwt >> b) & 1 != 0
        levels.append(packed(bit))
        bwt = np.concatenate([bwt[~bit], bwt[bit]])
    counts = np.bincount(x, minlength=top + 1).astype("<i4")
    return counts.tobytes(), levels, packed(sampled), order[sampled].astype("<i4").tobytes()


def build(docs: DataFrame, overlap: int = WINDOW - 1, shard: int | None = None) -> DataFrame:
    """Rows of ``INDEX``, for phrases of at most ``overlap`` + 1 words."""
    size = shard or SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        pieces: list[tuple[int, int | None, int, int, np.ndarray]] = []
        held = 0

        def flushed() -> pa.RecordBatch:
            lengths = np.array([len(p[4]) for p in pieces])
            starts = np.cumsum(np.r_[0, lengths[:-1] + 1])
            vocabulary, number = np.unique(np.concatenate([p[4] for p in pieces]), return_inverse=True)
            x = np.zeros(int(lengths.sum()) + len(pieces), np.int64)
            ends = np.zeros(len(x), bool)
            ends[starts + lengths] = True
            x[~ends] = number + 1
            counts, levels, marks, places = built(x, starts, max(1, len(vocabulary)))
            keys, ids, totals, firsts, _ = map(list, zip(*pieces))
            out = [keys, ids, totals, firsts, lengths, vocabulary.astype("<u8").tobytes(), counts, levels, marks, places]
            pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, INDEX)], schema=INDEX)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                hashes, sizes = word_hashes(part.column("text").to_pylist())
                for doc, words in zip(part.column("doc_id").to_pylist(), np.split(hashes, np.cumsum(sizes)[:-1])):
                    for first in range(0, max(1, len(words)), size):
                        piece = words[first : first + size + overlap]
                        if held and held + len(piece) + 1 > size:
                            yield flushed()
                            held = 0
                        pieces.append((row, doc, len(words), first, piece))
                        held += len(piece) + 1
                    row += 1
        if pieces:
            yield flushed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX_DDL)


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, words, bytes: the distinct windows of every item."""
    words = alnum_words_of(F.col("text"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words"))
        .distinct()
        .withColumn("bytes", F.octet_length(F.array_join("words", " ")))
    )


class Phrases:
    """A block of phrases in memory: distinct words and phrases, items of each."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        names: dict[str, int] = {}
        words: dict[bytes, int] = {}
        known: dict[tuple[int, ...], set[int]] = {}
        for item, window in rows:
            key = tuple(words.setdefault(w.encode(), len(words)) for w in window)
            known.setdefault(key, set()).add(names.setdefault(item, len(names)))
        self.items = list(names)
        self.words = word_hashes([" ".join(w.decode() for w in words)])[0]
        self.lengths = np.array([len(k) for k in known], np.int64)
        self.phrases = np.full((len(known), int(self.lengths.max(initial=1))), -1, np.int64)
        for i, k in enumerate(known):
            self.phrases[i, self.phrases.shape[1] - len(k) :] = k
        owners = [sorted(v) for v in known.values()]
        self.owner_cuts = np.cumsum([0, *map(len, owners)])
        self.owners = np.array([i for o in owners for i in o], np.int64)

    def of_phrases(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``chosen`` its items: (place in chosen, item)."""
        n = self.owner_cuts[chosen + 1] - self.owner_cuts[chosen]
        place = np.repeat(np.arange(len(chosen)), n)
        inside = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        return place, self.owners[self.owner_cuts[chosen][place] + inside]


def found(index: Shard, starts: np.ndarray, block: Phrases, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which words of the shard are hit, distinct pairs document * items + item)."""
    place = np.minimum(np.searchsorted(vocabulary, block.words), max(0, len(vocabulary) - 1))
    there = vocabulary[place] == block.words if len(vocabulary) else np.zeros(len(place), bool)
    mine = np.r_[np.where(there, place + 1, 0), 0]
    low, high = index.ranges(mine[block.phrases], block.lengths)
    some = np.flatnonzero(high > low)
    cuts = np.r_[0, np.cumsum(high[some] - low[some])]
    change, pairs = np.zeros(index.n + 1, np.int64), [np.empty(0, np.int64)]
    for a in range(0, int(cuts[-1]), FOUND):
        i = np.arange(a, min(a + FOUND, int(cuts[-1])))
        which = np.searchsorted(cuts, i, "right") - 1
        phrase = some[which]
        at = index.locate(low[phrase] + i - cuts[which])
        change += np.bincount(at, minlength=index.n + 1) - np.bincount(at + block.lengths[phrase], minlength=index.n + 1)
        doc = np.searchsorted(starts, at, "right") - 1
        seen = np.unique(doc * len(block.phrases) + phrase)
        place, item = block.of_phrases(seen % len(block.phrases))
        pairs.append(np.unique(seen[place] // len(block.phrases) * len(block.items) + item))
    return np.cumsum(change[:-1]) > 0, np.unique(np.concatenate(pairs))


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
HITS = pa.schema(
    [("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(SPAN)), ("items", pa.list_(pa.string()))]
)
HITS_DDL = "key long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def cut_lists(doc: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Lists of ``values``, whose documents ``doc`` ascend, for documents 0..n-1."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), values)


def search(index: DataFrame, rows: list[tuple[str, list[str]]], all_docs: bool) -> DataFrame:
    """``HITS`` of one block of phrases; without ``all_docs`` only documents hit."""
    sent = index.sparkSession.sparkContext.broadcast(Phrases(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c: b.column(c)[r]  # noqa: B023, E731
                lengths = get("lengths").values.to_numpy()
                starts = np.cumsum(np.r_[0, lengths[:-1] + 1])
                vocabulary = np.frombuffer(get("vocabulary").as_py(), "<u8")
                shard = Shard(
                    np.frombuffer(get("counts").as_py(), "<i4").astype(np.int64), get("levels").as_py(),
                    get("marks").as_py(), np.frombuffer(get("places").as_py(), "<i4").astype(np.int64),
                )
                hit, pairs = found(shard, starts, block, vocabulary)
                edge = np.flatnonzero(np.diff(np.r_[False, hit, False]))
                begin, end = edge[::2], edge[1::2]
                of = np.searchsorted(starts, begin, "right") - 1
                shift = get("firsts").values.to_numpy()[of] - starts[of]
                spans = pa.StructArray.from_arrays([pa.array(begin + shift), pa.array(end + shift)], fields=list(SPAN))
                doc, item = pairs // max(1, len(block.items)), pairs % max(1, len(block.items))
                names = pa.array(block.items, pa.string()).take(pa.array(item))
                out = pa.RecordBatch.from_arrays(
                    [get("keys").values, get("doc_ids").values, get("totals").values,
                     cut_lists(of, len(lengths), spans), cut_lists(doc, len(lengths), names)], schema=HITS,
                )
                keep = np.ones(len(lengths), bool) if all_docs else np.isin(np.arange(len(lengths)), doc)
                yield out.filter(pa.array(keep))

    return index.mapInArrow(run, HITS_DDL)


def merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (s["start"] <= F.get(done, F.size(done) - 1)["end"]),
                      F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shard: int | None = None, work: Workspace | None = None
) -> DataFrame:
    """key (of the row), doc_id, n_words, spans (start, end in words, merged) and
    items (sorted) of every row of ``docs``."""
    work = work or Workspace(docs.sparkSession, "fmindex")
    index = work.save(build(docs, window - 1, shard), "index")
    tests = phrases(items, window)
    total = tests.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-total["n"] // BLOCK_ROWS), -(-total["b"] // BLOCK_BYTES))
    tests = work.save(tests.repartition(blocks).withColumn("block", F.spark_partition_id()), "phrases")
    hits = None
    for k in range(blocks):
        # a block is bounded in rows and bytes
        rows = [(r["item"], r["words"]) for r in tests.where(F.col("block") == k).select("item", "words").collect()]
        part = search(index, rows, all_docs=k == 0)
        hits = part if hits is None else hits.union(part)
    return (
        hits.groupBy("key")
        .agg(F.any_value("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
             F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        .select("key", "doc_id", "n_words", merged(F.col("spans")).alias("spans"),
                F.array_sort(F.array_distinct("items")).alias("items"))
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the words of hit spans taken out of the texts, together with
    what stands between them; documents without hits come back unchanged."""
    work = Workspace(docs.sparkSession, "fmindex")
    whole = work.save(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("place")), "documents")
    keyed = whole.select(F.col("place").alias("doc_id"), F.col("row.text").alias("text"))
    hits = contamination(keyed, items, window, work=work).where(F.size("spans") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [without(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("place"), pa.array(cut, pa.string())], names=["place", "clean"])

    cleaned = (
        whole.join(hits.select(F.col("doc_id").alias("place"), "spans"), "place")
        .select("place", F.col("row.text").alias("text"), "spans").mapInArrow(run, "place long, clean string")
    )
    return whole.join(cleaned, "place", "left").select(
        *(F.coalesce("clean", "row.text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns)
    )


def without(text: str, spans: list[dict]) -> str:
    """``text`` without the words [start, end) of each span."""
    data = (text or "").encode("utf-8", "surrogatepass")
    inside = np.frombuffer(data.translate(FLAGS), np.uint8) == 1
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    begin, end = edge[::2], edge[1::2]
    out, at = [], 0
    for s in spans:
        out.append(data[at : begin[s["start"]]])
        at = int(end[s["end"] - 1])
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


# 1 for the bytes of words, 0 for those between
FLAGS = bytes(0 if alnum_words(chr(b)) == [] and b < 128 else 1 for b in range(256))


def query(spark: SparkSession, folder: str) -> DataFrame:
    found_ = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found_.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tests AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m,
         array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM tests WHERE len(w) > 0)),
widths AS (SELECT DISTINCT m FROM phrase),
windows AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, widths WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, m, item_id FROM windows JOIN phrase USING (m, p)),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

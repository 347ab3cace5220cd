"""Ranked lexical search: exact top-k by a dual-tree search.

A document's worth for a term is an integer that rises with the term's frequency
and falls with the document's length; an item's score of a document is the sum of
weight times worth over the item's terms.

1. ``vectors``: one pass turns each document into its counts of the items' terms
   and its number of all terms, written to the shared folder. Document
   frequencies and totals are aggregations of that table.
2. ``search``: every task takes its vectors in chunks. A chunk is a hierarchy:
   documents whose dearest terms are alike stand together in leaves, leaves in
   nodes; a node holds the greatest worth of each term below it. Items form a
   hierarchy too, whose nodes hold the terms of all items below. Both go down
   together: the sum of weight times greatest worth over an item node's terms
   bounds the score of every pair below. A pair of nodes whose bound is under the
   weakest k-th score of the node's items so far is left out, which is exact. What
   reaches the leaves is scored in full.
3. The best k of each task are written; the greatest of the tasks' k-th scores
   bounds what can still be among the first k, so few rows meet in the last
   ranking.

Items are taken in blocks bounded by their terms, one pass over the documents for
each. Equal scores rank by doc_id, a null doc_id last. Rows are documents, also
where they repeat; each row of items is an item. Null texts, and texts without
terms, have no score and count for no statistic; scores of 0 are not returned.
Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from figureyard.llm.common import Workspace, alnum_words_of, table
from figureyard.llm.wordhash import word_hashes

K = 50
BLOCK_TERMS, BLOCK_ITEMS = 1 << 18, 4096  # items searched together
FANS = (64, 8, 8)  # children of the root, of a node, of a leaf
ITEM_FAN = 4

VECTORS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
VECTORS_DDL = "doc_id long, n long, terms array<int>, tf array<int>"


def vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n and the counts of ``terms`` (their places) of every document."""
    known = word_hashes([" ".join(terms)])[0]
    order = np.argsort(known)
    sent = docs.sparkSession.sparkContext.broadcast((known[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, place = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                h, sizes = word_hashes(part.column("text").to_pylist())
                doc = np.repeat(np.arange(len(sizes)), sizes)
                if len(hashes):
                    i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    mine = hashes[i] == h
                    key, tf = np.unique(doc[mine] * len(hashes) + place[i[mine]], return_counts=True)
                else:
                    key, tf = np.empty((2, 0), np.int64)
                cuts = pa.array(np.searchsorted(key, np.arange(len(sizes) + 1) * len(hashes)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v, pa.int32())) for v in (key % max(1, len(hashes)), tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), *lists], schema=VECTORS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, VECTORS_DDL)


class Items:
    """The hierarchy over items: levels from the root's children to the items, each
    with the terms of its nodes, one after the other."""

    def __init__(self, terms: list[list[int]], weights: np.ndarray):
        self.weights = weights
        # items that share a dear term stand together
        dear = [sorted(t, key=lambda i: (-weights[i], i)) for t in terms]
        self.order = sorted(range(len(terms)), key=lambda i: dear[i])
        level = [np.array(sorted(terms[i]), np.int64) for i in self.order]
        self.sizes, self.levels = [len(level)], [self.laid(level)]
        while len(level) > ITEM_FAN:
            level = [np.unique(np.concatenate(level[i : i + ITEM_FAN])) for i in range(0, len(level), ITEM_FAN)]
            self.sizes.insert(0, len(level))
            self.levels.insert(0, self.laid(level))

    @staticmethod
    def laid(nodes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([*nodes, np.empty(0, np.int64)]), np.cumsum([0, *map(len, nodes)])

    def bounds(self, level: int, nodes: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Sums of ``gain`` (rows of a value for each term) over the nodes' terms."""
        terms, cuts = self.levels[level]
        n = cuts[nodes + 1] - cuts[nodes]
        first = np.cumsum(n) - n
        at = np.repeat(cuts[nodes] - first, n) + np.arange(int(n.sum()))
        return np.add.reduceat(gain[:, terms[at]], first, axis=1)

    def weakest(self, least: np.ndarray) -> list[np.ndarray]:
        """The weakest k-th score below each node of each level."""
        out = [least]
        while len(out) < len(self.levels):
            out.insert(0, np.minimum.reduceat(out[0], np.arange(0, len(out[0]), ITEM_FAN)))
        return out

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Nodes of ``level`` below ``nodes`` of the level above."""
        out = (nodes[:, None] * ITEM_FAN + np.arange(ITEM_FAN)).ravel()
        return out[out < self.sizes[level]]


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, item: int, score: int, doc: int | None) -> None:
        heap, entry = self.heaps[item], (score, doc is not None, 0 if doc is None else -doc)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[item] = heap[0][0]


class Search:
    """Searches chunks of documents for all items, keeping the best."""

    def __init__(self, items: Items, k: int, docs: int, words: int, fans: tuple[int, int, int] = FANS):
        self.items, self.docs, self.words, self.fans = items, docs, words, fans
        self.best = Best(items.sizes[-1], k)
        self.gain = np.zeros((fans[2], len(items.weights)), np.int64)
        self.scored = 0  # pairs scored in full

    def worth(self, n: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        m = 50 + (50 * n * self.docs) // max(1, self.words)
        return (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, sizes))

    def chunk(self, ids: list, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        value = self.worth(n, tf, sizes) * self.items.weights[terms]
        some = np.flatnonzero(sizes)
        if not len(some):
            return
        cuts = np.cumsum(np.r_[0, sizes])
        # documents by their dearest term, dearest first among those
        doc = np.repeat(np.arange(len(sizes)), sizes)
        top = np.maximum.reduceat(value, cuts[some])
        first = np.full(len(sizes), len(value))
        at = np.flatnonzero(value == np.repeat(top, sizes[some]))
        np.minimum.at(first, doc[at], at)
        order = some[np.lexsort((-top, terms[first[some]]))]
        n_of = sizes[order]
        take = np.repeat(cuts[order], n_of) + np.arange(int(n_of.sum())) - np.repeat(np.cumsum(n_of) - n_of, n_of)
        self.place = np.repeat(np.arange(len(order)), n_of)
        self.terms, self.value = terms[take], value[take]
        self.ids = [ids[i] for i in order]
        self.nodes = []
        width, place = 1, self.place
        for fan in (1, *self.fans[::-1]):
            width *= fan
            self.nodes.append(self.maxima(self.place // width) if width > 1 else (place, self.terms, self.value))
        # node boundaries among the rows of each level
        self.cuts = [np.searchsorted(p, np.arange(int(p[-1]) + 2)) for p, _, _ in self.nodes]
        self.visit(3, 0, 0, np.arange(self.items.sizes[0]))

    def maxima(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, term, greatest value) of the documents below each node."""
        key = node * len(self.items.weights) + self.terms
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first] // len(self.items.weights), key[first] % len(self.items.weights), np.maximum.reduceat(self.value[order], first)

    def filled(self, height: int, nodes: range) -> np.ndarray:
        """A row of values of all terms for each of ``nodes``, in the one buffer."""
        _, terms, value = self.nodes[height]
        cuts = self.cuts[height]
        for r, k in enumerate(nodes):
            self.gain[r, terms[cuts[k] : cuts[k + 1]]] = value[cuts[k] : cuts[k + 1]]
        return self.gain[: len(nodes)]

    def cleared(self, height: int, nodes: range) -> None:
        _, terms, _ = self.nodes[height]
        a, b = self.cuts[height][nodes[0]], self.cuts[height][nodes[-1] + 1]
        self.gain[: len(nodes), terms[a:b]] = 0

    def visit(self, height: int, node: int, level: int, found: np.ndarray) -> None:
        """``found``: nodes of the items' ``level`` that may have pairs below ``node``."""
        last = len(self.items.levels) - 1
        gain = self.filled(height, range(node, node + 1))
        while True:
            bound = self.items.bounds(level, found, gain)[0]
            found = found[bound >= self.items.weakest(self.best.least)[level][found]]
            # items go down at least as fast as documents
            if not len(found) or level == last or last - level < height:
                break
            level += 1
            found = self.items.children(level, found)
        self.cleared(height, range(node, node + 1))
        if not len(found):
            return
        fan = (1, *self.fans[::-1])[height]
        below = range(node * fan, min((node + 1) * fan, len(self.cuts[height - 1]) - 1))
        if height > 1:
            deeper = self.items.children(level + 1, found) if level < last else found
            for k in below:
                self.visit(height - 1, k, min(last, level + 1), deeper)
            return
        while level < last:
            level += 1
            found = self.items.children(level, found)
        scores = self.items.bounds(last, found, self.filled(0, below))
        self.cleared(0, below)
        self.scored += scores.size
        for r, c in zip(*np.nonzero(scores >= self.best.least[found])):
            self.best.add(int(found[c]), int(scores[r, c]), self.ids[below[r]])


FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("least", pa.int64())])


def search(
    vecs: DataFrame, terms: list[list[int]], weights: np.ndarray, k: int, docs: int, words: int, fans: tuple[int, int, int] = FANS
) -> DataFrame:
    """item (place in ``terms``), doc_id, score, least (the task's k-th score, 0 if
    it has fewer): the best k of each task."""
    sent = vecs.sparkSession.sparkContext.broadcast(Items(terms, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, chunk = Search(sent.value, k, docs, words, fans), math.prod(fans)
        for b in batches:
            for at in range(0, b.num_rows, chunk):
                p = b.slice(at, chunk)
                sizes = p.column("terms").value_lengths().to_numpy()
                state.chunk(
                    p.column("doc_id").to_pylist(), p.column("n").to_numpy(), sizes,
                    p.column("terms").flatten().to_numpy(), p.column("tf").flatten().to_numpy().astype(np.int64),
                )
        rows = [
            (state.items.order[i], -neg if there else None, score, heap[0][0] if len(heap) == k else 0)
            for i, heap in enumerate(state.best.heaps) for score, there, neg in heap
        ]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows)], schema=FOUND)

    return vecs.mapInArrow(run, "item long, doc_id long, score long, least long")


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def ranked(docs: DataFrame, items: DataFrame, k: int = K, fans: tuple[int, int, int] = FANS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    work = Workspace(spark, "dualtree")
    wanted = items.select("item_id", F.array_distinct(alnum_words_of(F.col("text"))).alias("words")).where(F.size("words") > 0)
    total = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("t")).first()
    blocks = max(1, -(-total["n"] // BLOCK_ITEMS), -(-total["t"] // BLOCK_TERMS))
    wanted = work.save(wanted.repartition(blocks).withColumn("block", F.spark_partition_id()).withColumn("item", F.monotonically_increasing_id()), "items")
    parts = []
    for b in range(blocks):
        # a block is bounded in items and terms
        rows = wanted.where(F.col("block") == b).select("item", "words").collect()
        places: dict[str, int] = {}
        terms = [[places.setdefault(w, len(places)) for w in r["words"]] for r in rows]
        vecs = work.save(vectors(docs, list(places)), "vectors")
        counted = vecs.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        df = dict(vecs.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([weight(counted["docs"], df.get(t, 0)) for t in range(len(places))], np.int64)
        if not rows:
            continue
        best = search(vecs, terms, weights, k, counted["docs"], counted["words"], fans)
        numbers = np.array([r["item"] for r in rows], np.int64).tolist()
        parts.append(work.save(best.withColumn("item", F.get(F.array(*map(F.lit, numbers)), F.col("item").cast("int"))), "best"))
        work.drop(vecs)
    if not parts:
        empty = wanted.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
        return empty.where("false")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    least = found.groupBy("item").agg(F.max("least").alias("bound"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = (
        found.join(least, "item").where("score >= bound")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    )
    return top.join(wanted.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tests AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS l FROM words WHERE len(w) > 0),
tf AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf
       FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM words) GROUP BY ALL),
df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
weight AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
scored AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // l))))::BIGINT AS score
  FROM tests JOIN tf USING (t) JOIN weight USING (t), total GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 50
"""

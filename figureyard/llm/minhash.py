"""Near-duplicate groups by b-bit MinHash, confirmed on whole shingle sets.

1. One pass over the texts makes a sketch: the minima of ``BANDS x ROWS`` hash
   functions over the distinct word shingles. Full minima give band keys; of
   each minimum only the low two bits are kept, packed into four longs.
2. Documents with equal sets are one class, represented by the smallest id.
   Class members are never paired.
3. Classes meeting in a band are candidates. The share of equal two-bit values,
   corrected for the quarter that agrees by chance, estimates similarity; only
   pairs that could reach the threshold (five standard deviations) stay. A bit
   map of the parities of hashed shingles then bounds the sets' difference from
   below, so that pairs certainly under the threshold go. What is left is
   confirmed on the sets of the whole texts.
4. Pairs inside a band are not all made. First each class is confirmed with its
   likeliest band representative and components form; then components are joined
   by their likeliest pairs; what then still shares a band across two components
   is compared completely, except inside the largest component of the band. So
   no link between different texts is lost, while groups of thousands of copies
   take a number of comparisons linear in their size.

Null and empty texts have no shingle, are linked with nothing and form their own
component. Texts shorter than a shingle are one shingle. Rows count by themselves,
also where they share an id: each belongs to the component of its own text. A
component of null ids alone has no id, and its rows are kept; else a null id is
never the component's. Inside, rows go by their place in a scan of ``docs``, which
has to be a stored table; a scan that changes in between is noticed. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figureyard.llm.common import (
    LOWER, SPACES, UPPER, Workspace, batches, coded_words, objects, packed as packed_rows, place, table, unpacked,
)

BANDS, ROWS, BITS = 32, 4, 2
HASHES = BANDS * ROWS
PARITY = 1024
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
STEPS = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
LOWERED = bytes.maketrans((UPPER + SPACES).encode(), (LOWER + " " * len(SPACES)).encode())


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def parted(text: str | None) -> bytes:
    """The words of ``text`` with spaces between them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWERED)


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    return mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text whose words have the
    hashes ``h``; fewer words are one shingle."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < k:
        x = np.array([n], np.uint64)
        for j in range(n):
            x = x * np.uint64(1_000_003) + h[j : j + 1] * STEPS[j : j + 1]
        return mixed(x)
    x = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        x += h[j : n - k + 1 + j] * STEPS[j]
    x = np.sort(mixed(x))  # np.unique would hash first
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def minima(sets: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over a set, a block of elements at a time."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sets), 1024):
        np.minimum(low, (sets[i : i + 1024, None] * FACTORS + SHIFTS).min(0), out=low)
    return mixed(low)


def packed(values: np.ndarray) -> np.ndarray:
    """The low bits of each row of minima, 32 of them in each long."""
    low = (values & np.uint64(2**BITS - 1)).reshape(len(values), -1, 64 // BITS)
    places = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(low << places, axis=2).view(np.int64)


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key for each band of each row of minima, different bands apart."""
    x = (values.reshape(-1, BANDS, ROWS) * STEPS[:ROWS]).sum(2, dtype=np.uint64)
    return mixed(x + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def parities(sets: np.ndarray) -> list[int]:
    """A bit for each of ``PARITY`` cells: odd number of elements in it. Sets
    differ in at least as many elements as their maps differ in bits."""
    odd = np.bincount((sets % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


SKETCH = (
    "place long, doc_id long, n long, digest binary, sig array<long>, parity array<long>, bands array<long>"
)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """Columns of ``SKETCH``; digest, sig, parity and bands are null for empty sets."""
    schema = pa.schema(
        [("place", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
         ("sig", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))]
    )

    def rows(columns: list) -> list[tuple]:
        distinct, texts = coded_words([parted(t) for t in columns[2]])
        hashes = word_hashes(objects(distinct))
        sets = [shingles(hashes[text], k) for text in texts]
        low = np.array([minima(s) for s in sets])
        return [
            (at, i, len(s), blake2b(s.tobytes(), digest_size=16).digest(), sig, parities(s), bands)
            if len(s) else (at, i, 0, None, None, None, None)
            for at, i, s, sig, bands in zip(*columns[:2], sets, packed(low).tolist(), band_keys(low).tolist())
        ]

    return docs.mapInArrow(batches(rows, ["place", "doc_id", "text"], schema), SKETCH)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from equal low bits, corrected for chance agreement."""
    odd = F.lit(0x5555555555555555)
    differ = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
    chance = 1 / 2**BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """Five standard deviations of the estimate below the threshold."""
    chance = 1 / 2**BITS
    p = chance + (1 - chance) * percent / 100
    return (p - 5 * (p * (1 - p) / HASHES) ** 0.5 - chance) / (1 - chance)


def reachable(a: Column, b: Column, percent: int) -> Column:
    """Whether sketches a and b (sig, n, parity) may reach the threshold."""
    differ = F.lit(0)
    for i in range(PARITY // 64):
        differ = differ + F.bit_count(F.get(a["parity"], F.lit(i)).bitwiseXOR(F.get(b["parity"], F.lit(i))))
    # a similarity of p percent allows a difference of (100 - p) / (100 + p) of both sizes
    return (estimate(a["sig"], b["sig"]) >= least_estimate(percent)) & (
        differ * (100 + percent) <= (a["n"] + b["n"]) * (100 - percent)
    )


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(columns: list) -> list[tuple]:
        sets = {}

        def of(i: int, z: bytes) -> np.ndarray:
            if i not in sets:
                if len(sets) > 64:
                    sets.clear()
                sets[i] = shingles(word_hashes(zstandard.decompress(z).split()), k)
            return sets[i]

        out = []
        for a, b, za, zb in zip(*columns):
            x, y = of(a, za), of(b, zb)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                out.append((a, b))
        return out

    ta = texts.select(F.col("rep").alias("a"), F.col("z").alias("za"))
    tb = texts.select(F.col("rep").alias("b"), F.col("z").alias("zb"))
    return (
        pairs.select("a", "b").join(ta, "a").join(tb, "b").select("a", "b", "za", "zb")
        .mapInArrow(batches(rows, ["a", "b", "za", "zb"], schema), "a long, b long")
    )


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of ``edges``.

    Labels fall to the smallest of the neighbours' and then to their label's own
    label, until nothing changes; tables are written each time.
    """
    one = work.save(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a < b").distinct(), "edges"
    )
    both = one.union(one.select("b", "a")).toDF("u", "v")
    labels = work.save(
        both.groupBy("u").agg(F.min("v").alias("m"))
        .select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels"
    )
    while True:
        near = (
            both.join(labels, both.v == labels.node)
            .groupBy("u").agg(F.min("label").alias("m"))
        )
        fallen = labels.join(near, labels.node == near.u).select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label")
        )
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = work.save(
            fallen.join(up, "label", "left")
            .select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")),
            "labels",
        )
        work.drop(labels)
        labels = new
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")


def merged(work: Workspace, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (rep, label) after joining components along ``edges``."""
    la = labels.select(F.col("rep").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("rep").alias("b"), F.col("label").alias("lb"))
    between = (
        edges.join(la, "a").join(lb, "b")
        .select(F.col("la").alias("a"), F.col("lb").alias("b"))
    )
    roots = components(work, between).toDF("label", "root")
    return work.save(
        labels.join(roots, "label", "left").select(
            "rep", F.coalesce("root", "label").alias("label")
        ),
        "merged",
    )


def placed_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """place, doc_id, n_shingles, component_id and group for every row of ``docs``.

    ``group`` numbers the components of rows with shingles and is null for others.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    docs = docs.select(place().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = work.save(sketches(docs, k), "sketches")
    classes = (
        sketch.where("digest is not null")
        .groupBy("digest").agg(F.min("place").alias("rep"), F.min("doc_id").alias("low"))
    )
    classes = work.save(classes, "classes")
    own = (
        sketch.join(classes.select("digest", "rep"), "digest")
        .where("place = rep")
        .select("rep", F.struct("sig", "n", "parity").alias("sig"), "bands")
    )
    own = work.save(own, "representatives")
    keyed = own.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"))
    bands = work.save(
        keyed.join(shared.where("pivot < last").drop("last"), "key"), "bands"
    )
    reps = bands.select("rep").distinct()
    labels = work.save(reps.withColumn("label", F.col("rep")), "labels")
    sigs = work.save(own.join(labels.select("rep"), "rep").select("rep", "sig"), "signatures")
    work.drop(own)

    def squeezed(columns: list) -> list[tuple]:
        pack = zstandard.ZstdCompressor(level=3)
        return [(i, pack.compress(parted(t))) for i, t in zip(*columns)]

    texts = docs.mapInArrow(
        batches(squeezed, ["place", "text"], pa.schema([("rep", pa.int64()), ("z", pa.binary())])),
        "rep long, z binary",
    )
    # the ids grow with the documents: dealt by id at every size, never sent around
    texts = work.save(texts.join(labels.select("rep").hint("merge"), "rep"), "texts")
    if texts.count() != labels.count():
        raise RuntimeError("the documents were read in another order: store them first")

    sa = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
    sb = sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    stars = (
        bands.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
        .distinct().join(sa, "a").join(sb, "b")
        .where(reachable(F.col("sa"), F.col("sb"), percent))
        .select("a", "b", estimate(F.col("sa.sig"), F.col("sb.sig")).alias("est"))
    )
    stars = work.save(stars, "stars")

    # each class with its likeliest representative
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b"))
    labels = merged(work, labels, work.save(confirmed(best, texts, k, percent), "links"))

    # each two components that meet at a representative by their likeliest pair
    la = labels.select(F.col("rep").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("rep").alias("b"), F.col("label").alias("lb"))
    across = (
        stars.join(la, "a").join(lb, "b").where("la <> lb")
        .groupBy(F.least("la", "lb"), F.greatest("la", "lb"))
        .agg(F.max_by(F.struct("a", "b"), F.struct("est", "a", "b")).alias("p")).select("p.*")
    )
    labels = merged(work, labels, work.save(confirmed(across, texts, k, percent), "links"))

    # all that still meets in a band across two components
    placed = bands.select("key", "rep").join(labels, "rep")
    sizes = placed.groupBy("key", "label").count()
    split = (
        sizes.groupBy("key")
        .agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.count("*").alias("c"))
        .where("c > 1").drop("c")
    )
    mixed_bands = work.save(placed.join(split, "key").join(sigs, "rep"), "mixed")
    left = mixed_bands.where("label <> most").select(
        "key", F.col("rep").alias("a"), F.col("label").alias("la"), F.col("sig").alias("sa")
    )
    right = mixed_bands.select(
        "key", F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("sig").alias("sb"), "most"
    )
    rest = (
        left.join(right, "key")
        .where((F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("most")) | (F.col("a") < F.col("b"))))
        .where(reachable(F.col("sa"), F.col("sb"), percent))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    labels = merged(work, labels, work.save(confirmed(rest, texts, k, percent), "links"))
    work.drop(texts, sigs, stars, bands, mixed_bands)

    grouped = classes.join(labels, "rep", "left").withColumn("group", F.coalesce("label", "rep"))
    ids = grouped.groupBy("group").agg(F.min("low").alias("component_id"))
    found = grouped.select("digest", "group").join(ids, "group")
    return (
        sketch.select("place", "doc_id", "n", "digest").join(found, "digest", "left")
        .select("place", "doc_id", F.col("n").alias("n_shingles"),
                F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "group")
    )


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Documents whose sets of distinct k-word shingles have a Jaccard similarity of
    at least ``percent`` are linked; component_id is the smallest doc_id
    reachable.
    """
    return (
        placed_groups(docs, k, percent)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", "kept")
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, among
    several the first. Rows without shingles all stay."""
    rows = placed_groups(docs, k, percent)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "place")
    winners = rows.where("group is not null").groupBy("group").agg(F.min_by("place", first).alias("place"))
    stays = winners.select("place").union(rows.where("group is null").select("place"))
    return unpacked(packed_rows(docs, place().alias("place")).join(stays, "place", "left_semi"), docs.columns)


def query(spark, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents"), k=2, percent=80)


# Exact by a join on shared shingles; for small tables.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) > 1)
  UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep
        FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id)),
r AS (SELECT s.* FROM s JOIN cls USING (doc_id) WHERE doc_id = rep),
inter AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM inter JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT DISTINCT x AS a, x AS b FROM both_ways
  UNION SELECT reach.a, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.b),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
       coalesce(low.m, cls.rep, d.doc_id) AS component_id,
       d.doc_id = coalesce(low.m, cls.rep, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN cls USING (doc_id) LEFT JOIN low ON low.a = cls.rep
"""

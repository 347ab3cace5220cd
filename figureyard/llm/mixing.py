"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words: its share, by weight, of ``total`` times all
words; a source's target stops at ``most`` times its own words and the excess is
shared again by weight among the others, until none is above.

A target of r times a source's words takes floor(r) whole copies of each of its
documents for certain. The fraction left is a sample without replacement with
inclusion odds p / (1 - p), p that fraction: documents are ranked by the random
odds u / (1 - u) divided by their inclusion odds, and the first ranks are taken
until the words wanted are reached, so the sample's size is fixed. Inclusion
odds differ between documents of a source: long ones are likelier (``merit``).

u comes from a keyed hash of the document, so that reruns agree. Ranks are made
by a range sort of narrow rows, never by a task for a source.

Null texts have no words; documents without words are never sampled but get
their whole copies (which add nothing). A null source is a source, last in
order. Rows that repeat a doc_id are sampled each, and rows alike in doc_id and
text are told apart by their place in the written order. An empty table gives an
empty mix. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figureyard.llm.common import Workspace, ordered, packed, place, table, unpacked, words_of

WEIGHTS = (3.0, 1.0, 2.0)


def targets(work: Workspace, sizes: DataFrame, total: float, most: float) -> DataFrame:
    """source, source_size, weight, target of a table of (source, size).

    Rows are sources; only two sums of each round meet in the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ordered(
        work, sources, [F.col("source").isNull().cast("int").alias("_null"), F.col("source")]
    )
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("pos") % len(WEIGHTS)).cast("int"))
    rows = work.save(placed.withColumn("weight", weight).drop("pos"), "sources")
    full = F.lit(most) * F.col("source_size")
    everything = rows.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    share, capped = 0.0, -1
    while True:
        # at the share of a weight so far, who is full?
        is_full = full <= F.lit(share) * F.col("weight") if share else F.col("source_size") == 0
        r = rows.agg(
            F.count_if(is_full).alias("n"),
            F.sum(F.when(is_full, full)).alias("fixed"),
            F.sum(F.when(~is_full, F.col("weight"))).alias("open"),
        ).first()
        if r["n"] == capped or not r["open"]:
            break
        capped, share = r["n"], (total * everything - (r["fixed"] or 0.0)) / r["open"]
    return rows.withColumn(
        "target", F.least(full.cast("double"), F.lit(share) * F.col("weight"))
    )


def unit(*columns: Column, key: str) -> Column:
    """A number in (0, 1) from a keyed hash."""
    h = F.xxhash64(F.lit(key), *columns)
    return (F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def mix(
    docs: DataFrame, total: float = 1.5, most: float = 2.0, merit: str | None = None,
    key: str = "mix",
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and place (of the
    row in a scan of ``docs``) for every row.

    ``merit`` names a positive column that multiplies the inclusion odds; without
    one they grow with the square root of a document's words.
    """
    work = Workspace(docs.sparkSession, "mixing")
    size = F.coalesce(F.size(words_of(F.col("text"))), F.lit(0)).cast("long")
    odds = F.col(merit).cast("double") if merit else F.sqrt(F.greatest(size, F.lit(1)))
    rows = work.save(
        docs.select(
            "doc_id", "source",
            F.when(F.col("text").isNull(), F.lit(0)).otherwise(size).cast("long").alias("size"),
            F.xxhash64("text").alias("h"), odds.alias("merit"), place().alias("place"),
        ),
        "sizes",
    )
    wanted = work.save(targets(work, rows, total, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = (
        rows.alias("r").join(wanted.alias("w"), F.col("r.source").eqNullSafe(F.col("w.source")))
        .select("r.*", "source_size", "target", F.floor(ratio).alias("certain"),
                (ratio - F.floor(ratio)).alias("p"))
        .withColumn("u", unit(F.col("doc_id"), F.col("h"), key=key))
        .withColumn("rank", (F.col("u") / (1 - F.col("u")))
                    / (F.greatest("p", F.lit(1e-12)) / (1 - F.col("p")) * F.col("merit")))
    )
    ranked = ordered(
        work, known,
        [F.col("source").isNull().cast("int").alias("_null"), F.col("source"), F.col("rank"),
         F.col("doc_id"), F.col("h")],
        size="size",
    )
    ranked = work.save(ranked, "ranked")
    # words of all sources before this one, as the order is by source
    starts = ranked.groupBy("source").agg(F.min("before").alias("start"))
    extra = F.col("target") - F.col("certain") * F.col("source_size")
    return (
        ranked.alias("r").join(starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        .select("r.*", "start")
        # taken when its middle lies within the words wanted: off by half a document
        .withColumn("more", (F.col("before") - F.col("start") + F.col("size") / 2 <= extra)
                    & (F.col("p") > 0) & (F.col("size") > 0))
        .withColumn("copies", F.col("certain") + F.col("more").cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies",
                (F.col("copies") * F.col("size")).alias("taken"), "place")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, a stored table, as often as the mix takes them; each
    row goes by its place, so repeated ids don't share their copies."""
    copies = mix(docs, **options).where("copies > 0").select("place", F.col("copies").cast("int").alias("n"))
    taken = packed(docs, place().alias("place")).join(copies, "place")
    return unpacked(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))), docs.columns)


def query(spark, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )

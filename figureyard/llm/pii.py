"""Personal data: patterns, and terms that give the found entities away.

Patterns find e-mail addresses, IP addresses, card and telephone numbers. Their
values are the protected entities. A term near an entity tells something about
it: in bits, the pointwise mutual information of both, at most the entity's own
information -log2 p(entity). A term discloses an entity when it carries at least
``DISCLOSED`` of that.

The share of a term's documents that have it near the entity is smoothed by half
a document each way (Jeffreys), so an entity named once can be disclosed, by
terms that stand hardly anywhere else, and few witnesses weigh less than many. A
witness is a distinct text: copies of one text are one.

Probabilities are shares of documents: of the whole corpus for terms and
entities, of those with both near each other for pairs. Disclosing terms are
removed wherever they stand; entities are generalised to their kind.

Counting is joins and sums of narrow rows. What texts have to be searched for
reaches tasks as a bit set of fixed size that may let others pass; exact joins
follow. A null or empty text has no span. Rows that share a doc_id are
documents of their own, rows alike in everything get the same answer; a null
doc_id is allowed. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figureyard.llm.common import Workspace, batches, coded_words, objects, packed, slices, table, unpacked

KINDS = ("email", "ip", "card", "phone", "term")
NEAR = 8  # words before and after an entity
DISCLOSED = 0.9
BITS = 1 << 20

# Patterns, fixed values; parts before a match may not belong to its first run.
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")  # every entity has one of them
EDGES = ".,;:!?()[]{}\"'«»“”„*#$%&|<>-"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each @, in time linear in the text."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = at = m.end()
        else:
            at += 1
            done = at


def entities(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, by start, then kind."""
    if not HINT.search(text):
        return []
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def term(word: str) -> str | None:
    """The term that a word stands for: no marks at its edges, lower case."""
    t = word.strip(EDGES).lower()
    return t if len(t) > 2 and any(map(str.isalpha, t)) and "@" not in t else None


def words_before(text: str, at: int) -> list[str]:
    width = 128
    while len(words := text[max(0, at - width) : at].split()) <= NEAR and width < at:
        width *= 2
    return words[-NEAR:]


def words_after(text: str, at: int) -> list[str]:
    width = 128
    while len(words := text[at : at + width].split()) <= NEAR and at + width < len(text):
        width *= 2
    return words[:NEAR]


def near_entities(text: str) -> Iterator[tuple[int, str]]:
    """(entity, term) for terms within ``NEAR`` words of an entity."""
    for s, k, e in entities(text):
        name = KINDS[k] + re.sub(r"[\x20().-]", "", text[s:e]).lower() if k > 1 else KINDS[k] + text[s:e].lower()
        entity = int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        for t in {t for w in words_before(text, s) + words_after(text, e) if (t := term(w))}:
            yield entity, t


def bit_set(terms: DataFrame) -> bytes:
    """A set of fixed size that holds every term's hash."""
    place = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit(BITS - 1))
    rows = (
        terms.select(place.alias("h"))
        .groupBy((F.shiftright("h", 3)).alias("byte"))
        .agg(F.bit_or(F.expr("shiftleft(1, cast(h & 7 as int))")).alias("bits"))
        .collect()
    )  # at most BITS / 8 rows
    out = bytearray(BITS // 8)
    for r in rows:
        out[r["byte"]] = r["bits"]
    return bytes(out)


def coded_terms(texts: list[str | None]) -> tuple[pa.Array, list[np.ndarray]]:
    """The terms of all ``texts`` together, as ``term`` gives them of a word, and the
    places among them of each text's words. Places of what is no term hold null."""
    words, coded = coded_words([" ".join((t or "").lower().split()) for t in texts])
    terms = pc.utf8_trim(words.cast(pa.string()), EDGES).dictionary_encode()
    place, t = terms.indices.to_numpy(), terms.dictionary
    good = pc.and_(pc.greater(pc.utf8_length(t), 2), pc.invert(pc.match_substring(t, "@")))
    has_letter = pa.array([x.isalpha() or any(map(str.isalpha, x)) for x in objects(t)], pa.bool_())
    return pc.if_else(pc.and_(good, has_letter), t, None), [place[c] for c in coded]


def passing(terms: pa.Array, known: bytes) -> np.ndarray:
    """Which terms have their hash in the set ``known``."""
    h = np.array([-1 if t is None else zlib.crc32(t) & (BITS - 1) for t in objects(terms.cast(pa.binary()))], np.int64)
    return (h >= 0) & (np.frombuffer(known, np.uint8)[h >> 3] >> (h & 7) & 1 > 0)


def disclosing(work: Workspace, docs: DataFrame) -> DataFrame:
    """(term) table of the terms that disclose an entity of the corpus."""
    schema = pa.schema([("entity", pa.int64()), ("term", pa.string()), ("doc", pa.int64()), ("first", pa.int64())])

    def near(columns: list) -> list[tuple]:
        out = []
        for text in columns[0]:
            if text and HINT.search(text):
                doc = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                seen: set[str] = set()
                for e, t in set(near_entities(text)):
                    out.append((e, t, doc, int(t not in seen)))
                    seen.add(t)
        return out

    pairs = work.save(
        docs.select("text").mapInArrow(batches(near, ["text"], schema), "entity long, term string, doc long, first long"),
        "near",
    )
    all_docs = docs.count()
    entity_docs = (
        pairs.groupBy("entity", "doc").agg(F.count("*"))
        .groupBy("entity").agg(F.count("*").alias("de"))
    )
    # documents are counted with their copies, witnesses once
    together = (
        pairs.groupBy("entity", "term", "doc").agg(F.count("*").alias("n"))
        .groupBy("entity", "term").agg(F.count("*").alias("w"), F.sum("n").alias("n"))
    )
    information = F.log2(F.lit(float(all_docs)) / F.col("de"))
    # With share = (w + 1/2) / (w df / n + 1), information + log2(share) reaches
    # DISCLOSED * information as long as df is at most this.
    most = F.col("n") / F.col("w") * ((F.col("w") + 0.5) * F.pow(F.lit(2.0), information * (1 - DISCLOSED)) - 1)
    limits = (
        together.join(entity_docs, "entity").where(information > 0)
        .groupBy("term").agg(F.max(most).alias("most"))
    )
    # the documents that have a term near any entity are the least it can have
    least = pairs.groupBy("term").agg(F.sum("first").alias("least"))
    together = work.save(limits.join(least, "term").where("least <= most").select("term", "most"), "together")
    found = bit_set(together.select("term"))
    schema_count = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], schema=schema_count)
            seen.clear()
            return out

        for part in parts:
            for cut in slices(part):
                terms, texts = coded_terms(cut.column("text").to_pylist())
                n = np.zeros(len(terms), np.int64)
                for text in texts:
                    n[text] += 1  # once, however often a place is listed
                wanted = passing(terms, found)
                seen.update(dict(zip(terms.filter(pa.array(wanted)).to_pylist(), n[wanted].tolist())))
                if len(seen) > 100_000:
                    yield flushed()
        yield flushed()

    frequency = work.save(
        docs.select("text").mapInArrow(count, "term string, n long")
        .groupBy("term").agg(F.sum("n").alias("df")), "frequency",
    )
    told = together.join(frequency, "term").where("df <= most").select("term")
    return work.save(told, "disclosing")


ROW = (
    "doc_id long, h long, row long, n_email long, n_ip long, n_card long, n_phone long, "
    "base array<struct<s:long,k:int,e:long>>, maybe array<struct<s:long,e:long,term:string>>"
)


def marked(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """doc_id, h (hash of the text), base counts, base and all spans (arrays of
    start, kind, end by start, then kind), for every row."""
    work = work or Workspace(docs.sparkSession, "pii")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    told = disclosing(work, docs)
    known = bit_set(told)
    span = pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())])
    hit = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("term", pa.string())])
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "h", "row", "n_email", "n_ip", "n_card", "n_phone")]
        + [("base", pa.list_(span)), ("maybe", pa.list_(hit))]
    )

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40

        def rows(columns: list) -> list[tuple]:
            nonlocal row
            out = []
            terms, texts = coded_terms(columns[1])
            wanted = passing(terms, known)
            for i, text, h, held in zip(*columns, texts):
                text = text or ""
                base = entities(text)
                n = Counter(k for _, k, _ in base)
                maybe = []
                if len(some := held[wanted[held]]):
                    some = set(terms.take(pa.array(some)).to_pylist())
                    for m in re.finditer(r"\S+", text):
                        t = term(m.group())
                        if t in some:
                            s = m.start() + len(m.group()) - len(m.group().lstrip(EDGES))
                            maybe.append({"s": s, "e": m.start() + len(m.group().rstrip(EDGES)), "term": t})
                out.append((i, h, row, n[0], n[1], n[2], n[3], [{"s": s, "k": k, "e": e} for s, k, e in base], maybe))
                row += 1
            return out

        yield from batches(rows, ["doc_id", "text", "h"], schema)(parts)

    rows = work.save(docs.mapInArrow(mark, ROW), "marked")
    hits = (
        rows.select("row", F.explode("maybe").alias("m")).select("row", "m.*").join(told, "term")
        .groupBy("row").agg(F.collect_list(F.struct("s", F.lit(4).alias("k"), "e")).alias("terms"))
    )
    free = F.filter(
        F.col("terms"),
        lambda t: ~F.exists(F.col("base"), lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])),
    )
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(
        F.sort_array(F.concat(F.col("base"), free))
    )
    return rows.drop("maybe").join(hits, "row", "left").withColumn("spans", spans).drop("terms", "row")


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with entities replaced by their kind and disclosing terms removed."""
    columns = docs.columns
    rows = packed(docs, "doc_id", "text", F.xxhash64("text").alias("h"))
    marks = marked(docs).where(F.size("spans") > 0).select("doc_id", "h", "spans").dropDuplicates(["doc_id", "h"])
    joined = (
        rows.alias("d")
        .join(marks.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.h") == F.col("m.h")), "left")
        .select("row", "text", "spans")
    )
    names = {0: "<EMAIL>", 1: "<IP>", 2: "<CARD>", 3: "<PHONE>", 4: "<TERM>"}

    def clean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                if spans:
                    bits, done = [], 0
                    for x in spans:
                        if x["s"] >= done:
                            bits += [text[done : x["s"]], names[x["k"]]]
                        done = max(done, x["e"])
                    text = "".join(bits) + text[done:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    out = joined.mapInArrow(clean, joined.select("row", "text").schema)
    changed = {"text": F.col("text")}
    if "n_chars" in columns:
        changed["n_chars"] = F.length("text").cast("long")
    return unpacked(out, columns, **changed)


def query(spark, folder: str) -> DataFrame:
    found = marked(table(spark, folder, "documents"))
    kinds = F.array(*map(F.lit, KINDS))

    def joined(spans: str):
        return F.array_join(
            F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ","
        )

    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )

"""Line-first cleaning: rules on single lines first, then on what is left.

Every line of a document is judged by punctuation, navigation, shouting and
boilerplate rules. Failing lines go; a document that loses more than a share of
its words is rejected. Everything is SQL expressions on one row: no shuffle, and
a long text costs its own task only.

Null text counts as empty; an empty text keeps no line, has zero counts and is
rejected by the base rule (fewer than 50 words). Repeated rows are judged alike.
Extra columns pass through ``clean``; columns named like the outputs are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figureyard.llm.common import let, times, words_of, packed, unpacked

# Characters counted as symbols, and as marks of a sentence.
SYMBOLS = "#*$%&|<>"
ENDS = r"[.!?:;…。！？][\"'”’»)\]]*\s*$"
BOILERPLATE = (
    r"(?i)^\s*(all rights reserved|licensed under|released under|this work is licensed"
    r"|copyright \(c\)|terms of (use|service)|privacy policy|cookie(s| policy)"
    r"|accept cookies|enable javascript|subscribe to|sign up for|lorem ipsum"
    r"|share (this|on)|read more|click here)"
)


@dataclass(frozen=True)
class LineRules:
    """Parameters of the rules; shares are of a line's words."""

    unended_words: int = 10  # so long a line has to end a sentence ...
    words_per_mark: int = 50  # ... or to hold a mark for each so many words
    navigation_share: float = 0.3  # separators | > » · and the like
    symbol_share: float = 0.3  # symbols
    shouting_share: float = 0.5  # exclamation marks
    lost_share: float = 0.5  # a document may lose so much


def line_verdict(line: Column, n: Column, symbols: Column, rules: LineRules) -> Column:
    """The rule that a line of ``n`` words breaks, null if none.

    Blank lines pass. Order: boilerplate, navigation, symbols, shouting,
    punctuation.
    """
    unended = (n >= rules.unended_words) & ~F.substring(F.rtrim(line), -8, 8).rlike(ENDS)
    marks = times(line, ".!?;:")
    return (
        F.when(n == 0, None)
        .when(line.rlike(BOILERPLATE), F.lit("boilerplate"))
        .when(
            times(line, "|»·•›") >= F.greatest(F.lit(2.0), n * rules.navigation_share),
            F.lit("navigation"),
        )
        .when((n >= 3) & (symbols >= n * rules.symbol_share), F.lit("symbols"))
        .when((n >= 3) & (times(line, "!") >= n * rules.shouting_share), F.lit("shouting"))
        .when(unended & (marks * rules.words_per_mark < n), F.lit("punctuation"))
    )


def split_lines(text: Column) -> Column:
    """Array of (line, its words)."""
    return F.transform(
        F.split(text, "\n"), lambda line: F.struct(line.alias("line"), words_of(line).alias("w"))
    )


def judged_lines(lines: Column, rules: LineRules) -> Column:
    """Array of (line, n words, symbols, broken rule) of split lines."""
    return F.transform(
        lines,
        lambda x: let(
            F.struct(
                x["line"].alias("line"),
                F.size(x["w"]).alias("n"),
                times(x["line"], SYMBOLS).alias("s"),
            ),
            lambda y: y.withField("rule", line_verdict(y["line"], y["n"], y["s"], rules)),
        ),
    )


def repeated_words(words: Column, least: Column | int = 0) -> Column:
    """Words inside three-word windows that occur at least twice in the text;
    numbers under ``least`` may be given as 0.

    Most texts repeat no window, which the distinct count tells. Of the windows
    that repeat at most every second one is the first of its kind, so they cover at
    most six words for each one that the distinct count lacks. In the other texts
    windows are sorted with their positions, so equal ones are neighbours:
    n log n also for very long texts.
    """

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

    def same(s: Column, i: Column, g: Column) -> Column:
        return F.coalesce(F.get(s, i)["g"] == g, F.lit(False))

    def positions(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: same(s, i - 1, x["g"]) | same(s, i + 1, x["g"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(
                i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")
            ),
            lambda a: a["n"],
        )

    def count(g: Column) -> Column:
        pairs = F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))
        return let(
            F.size(g) - F.size(F.array_distinct(g)),
            lambda again: F.when((again == 0) | (6 * again < least), F.lit(0)).otherwise(
                let(F.sort_array(pairs), lambda s: let(positions(s), covered))
            ),
        )

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows(words), count))


def measures(
    docs: DataFrame, rules: LineRules = LineRules(), text: str = "text", exact: bool = True
) -> DataFrame:
    """``docs`` with base counts, lost and kept words, and both verdicts.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, lines (judged), n_kept_words and kept. Unless ``exact``,
    n_repeat_words may be 0 where too few words repeat to fail a document.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    split = (
        docs.withColumn("_lines", split_lines(t))
        .withColumn("_words", F.flatten(F.transform("_lines", lambda x: x["w"])))
        .withColumn("lines", judged_lines(F.col("_lines"), rules))
    )
    with_words = F.transform(
        F.filter(F.col("lines"), lambda x: x["n"] > 0), lambda x: x["line"]
    )
    counted = (
        split.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn(
            "n_symbols",
            F.aggregate(F.col("lines"), F.lit(0), lambda a, x: a + x["s"]).cast("long"),
        )
        .withColumn(
            "n_dup_lines",
            let(with_words, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        )
        .withColumn(
            "n_repeat_words",
            let(
                F.col("_words"), lambda w: repeated_words(w, 0 if exact else F.size(w) / 2)
            ).cast("long"),
        )
        .withColumn(
            "n_kept_words",
            F.aggregate(
                F.col("lines"),
                F.lit(0),
                lambda a, x: a + F.when(x["rule"].isNull(), x["n"]).otherwise(0),
            ).cast("long"),
        )
        .drop("_words", "_lines")
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn(
        "kept",
        ~F.col("base_failed")
        & (F.col("n_words") - F.col("n_kept_words") <= rules.lost_share * F.col("n_words")),
    )


def clean(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """Kept documents without their failing lines; n_chars follows the text.

    A filter on ``kept`` would be pushed below the projections, which then judge
    every line once for the filter and again for the text. ``explode`` drops a
    document whose text is null, and nothing moves past it.
    """
    left = F.array_join(
        F.transform(
            F.filter(F.col("lines"), lambda x: x["rule"].isNull()), lambda x: x["line"]
        ),
        "\n",
    )
    apart = packed(docs, F.col(text).alias("text"))
    kept = measures(apart, rules, exact=False).select(
        "row", F.explode(F.when(F.col("kept"), F.array(left))).alias("text")
    )
    changed = {text: F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast("long")
    return unpacked(kept, docs.columns, **changed)


def query(spark, folder: str) -> DataFrame:
    from figureyard.llm.common import table

    return measures(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_kept_words",
    )


# The same rules as SQL; the patterns are those above.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
ln AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line,
               generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)),
judged AS (
  SELECT doc_id, line, n,
    CASE WHEN n = 0 THEN NULL
         WHEN regexp_matches(line, '(?i)^\s*(all rights reserved|licensed under|released under|this work is licensed|copyright \(c\)|terms of (use|service)|privacy policy|cookie(s| policy)|accept cookies|enable javascript|subscribe to|sign up for|lorem ipsum|share (this|on)|read more|click here)')
           THEN 'boilerplate'
         WHEN len(regexp_extract_all(line, '[|»·•›]')) >= greatest(2.0, n * 0.3::DOUBLE) THEN 'navigation'
         WHEN n >= 3 AND len(regexp_extract_all(line, '[#*$%&|<>]')) >= n * 0.3::DOUBLE THEN 'symbols'
         WHEN n >= 3 AND len(regexp_extract_all(line, '!')) >= n * 0.5::DOUBLE THEN 'shouting'
         WHEN n >= 10 AND NOT regexp_matches(right(rtrim(line), 8), '[.!?:;…。！？]["''”’»)\]]*\s*$')
              AND len(regexp_extract_all(line, '[.!?;:]')) * 50 < n THEN 'punctuation' END AS rule
  FROM ln),
per_line AS (
  SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
         coalesce(sum(n) FILTER (rule IS NULL), 0)::BIGINT AS n_kept_words
  FROM judged GROUP BY doc_id),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (
  SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM twice GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         n_dup_lines::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         n_kept_words
  FROM d JOIN per_line USING (doc_id) LEFT JOIN rep ON rep.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND n_words - n_kept_words <= 0.5::DOUBLE * n_words AS kept
FROM m
"""

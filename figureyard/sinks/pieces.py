"""Ordered lines cut into pieces of bounded bytes, and a hash tree over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figureyard.operators.ranking import rank_within
from figureyard.session import materialised

# Bytes after which a piece ends, children of a node of the tree.
PIECE_BYTES, FAN = 1 << 20, 256


def numbered(lines: DataFrame, order: Sequence[str], line: str, size: int = PIECE_BYTES) -> DataFrame:
    """Add ``pos`` (from 1, over all lines in ``order``) and ``piece``: the bytes
    of all earlier lines over ``size``, rounded down.

    A piece holds at most ``size`` bytes and the line that crosses its end. The
    numbers follow from the lines and their order alone, not from partitions.
    Numbers may be left out after a line longer than a piece; null lines go.
    ``order`` must be unique.
    """
    sized = lines.filter(F.col(line).isNotNull()).withColumn("__size", F.octet_length(line).cast("bigint"))
    placed = rank_within(sized, [], [F.col(c) for c in order], name="pos", before={"__bytes": "__size"})
    return placed.withColumn("piece", F.expr(f"__bytes div {size}L")).drop("__bytes", "__size")


def joined(rows: DataFrame, line: str, separator: str = "\n") -> Column:
    """Aggregate: the lines of one piece in order, as one text."""
    inside = F.array_sort(F.collect_list(F.struct("pos", F.col(line).alias("line"))))
    return F.array_join(F.transform(inside, lambda x: x["line"]), separator)


def digest(rows: DataFrame, line: str, fan: int = FAN) -> DataFrame:
    """One row (root, lines, pieces): the root of a hash tree over the pieces of
    ``numbered`` rows. A leaf is the SHA-256 of a piece's text; node ``i`` of the
    next level is that of the hex hashes of nodes ``fan * i`` to ``fan * i + fan - 1``
    that exist. The level whose only number is 0 holds the root. No lines: the hash
    of the empty text.

    The same lines give the same root however they are partitioned, a task sees
    one piece or ``fan`` hashes, and levels grow with the logarithm of the bytes.
    """
    leaves = materialised(
        rows.groupBy(F.col("piece").alias("node")).agg(
            F.sha2(joined(rows, line), 256).alias("d"), F.count(F.lit(1)).alias("n")
        ),
        "hash-leaves",
    )
    top = leaves.agg(F.max("node").alias("top")).first()["top"] or 0
    level = leaves
    while top > 0:
        children = F.array_sort(F.collect_list(F.struct("node", "d")))
        level = materialised(
            level.groupBy(F.expr(f"node div {fan}L").alias("parent")).agg(
                F.sha2(F.array_join(F.transform(children, lambda x: x["d"]), ""), 256).alias("d")
            ).withColumnRenamed("parent", "node"),
            "hash-level",
        )
        top //= fan
    counts = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.count(F.lit(1)).alias("pieces"))
    root = level.agg(F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("root"))
    return root.join(counts)


def digest_sql(lines: str, order: str, size: int = PIECE_BYTES, fan: int = FAN, levels: int = 4) -> str:
    """The same in SQL for a query ``lines`` with column ``line``, up to
    ``fan ** levels`` pieces."""
    tree = [
        f"""sized AS (SELECT *, row_number() OVER (ORDER BY {order}) AS pos,
              CAST(coalesce(sum(octet_length(encode(line))) OVER (ORDER BY {order}
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {size} AS piece
            FROM ({lines}) WHERE line IS NOT NULL)""",
        """l0 AS (SELECT piece AS node, sha256(string_agg(line, chr(10) ORDER BY pos)) AS d, count(*) AS n
            FROM sized GROUP BY piece)""",
    ]
    for i in range(1, levels + 1):
        tree.append(
            f"""l{i} AS (SELECT node // {fan} AS node, sha256(string_agg(d, '' ORDER BY node)) AS d
                FROM l{i - 1} GROUP BY node // {fan})"""
        )
    tops = " UNION ALL ".join(
        f"SELECT {i} AS level, max(node) AS top, max(d) AS d FROM l{i}" for i in range(levels + 1)
    )
    return f"""WITH {", ".join(tree)}
        SELECT coalesce((SELECT arg_min(d, level) FROM ({tops}) WHERE top = 0), sha256('')) AS root,
               CAST((SELECT coalesce(sum(n), 0) FROM l0) AS BIGINT) AS lines, (SELECT count(*) FROM l0) AS pieces"""

"""Helpers shared by the training-data operators: columns, tables, global order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figureyard.session import shared_path

# White space of the word pattern [^\x20\x09-\x0D]+; a fixed value.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it as often as ``body`` wants.

    A column that is used inside a lambda would be put in line by the optimiser
    and evaluated again for each element; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def times(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.size(F.split(text, f"[{chars}]")) - 1


def words_of(text: Column, spaces: str = r"[\x20\x09-\x0D]+") -> Column:
    return F.array_remove(F.split(text, spaces), "")


# Bytes outside the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text are
# white space here; as all bytes of other characters are above 0x7F, working on
# UTF-8 gives the same words as working on code points.
BETWEEN = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
ALNUM = bytes.maketrans(UPPER.encode() + BETWEEN, LOWER.encode() + b" " * len(BETWEEN))


def alnum_words(text: str | None) -> list[bytes]:
    """Words of letters and digits, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM).split()


def alnum_words_of(text: Column) -> Column:
    """The same as an array of strings (null: null)."""
    return words_of(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def coded_words(texts: list[bytes]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words of ``texts``, which have spaces between words, and the
    words of each text as places among them. So what follows from a word by itself
    is worked out once for all texts."""
    split = pc.split_pattern(pa.array(texts, pa.binary()), b" ")
    coded = split.values.dictionary_encode()
    codes = coded.indices.to_numpy()
    is_word = (pc.binary_length(coded.dictionary).to_numpy() > 0)[codes]
    ends = np.concatenate([[0], np.cumsum(is_word)])[split.offsets.to_numpy()]
    codes = codes[is_word]
    return coded.dictionary, [codes[a:b] for a, b in pairwise(ends.tolist())]


def objects(values: pa.Array) -> np.ndarray:
    """Python's objects of ``values``, without the scalars that ``to_pylist`` makes of each."""
    return values.to_numpy(zero_copy_only=False)


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """The caller's row as one column ``row``, so that no name of it can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``row``, those ``changed`` taken from there."""
    return df.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def place() -> Column:
    """A number for each row of a scan, the same in each scan of a stored table."""
    return F.monotonically_increasing_id()


class Workspace:
    """Tables of one job in the shared folder: written once, read back, and
    removed as soon as nothing later reads them."""

    _record: list[Workspace] | None = None

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, shared_path(spark, name), 0
        if Workspace._record is not None:
            Workspace._record.append(self)

    @classmethod
    @contextmanager
    def recorded(cls, into: list[Workspace]) -> Iterator[None]:
        """List what is made meanwhile in ``into``, for ``remove`` later."""
        before, cls._record = cls._record, into
        try:
            yield
        finally:
            cls._record = before

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stored_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t.stored_at)

    def remove(self) -> None:
        """Everything; no frame that reads these tables may be used afterwards."""
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``part`` in slices that keep a task's Python objects few."""
    for start in range(0, part.num_rows, 512):
        yield part.slice(start, 512)


def batches(
    fn: Callable[[list], list[tuple]], columns: list[str], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow over rows: ``fn`` gets the lists of ``columns`` of a slice of a
    batch and returns output rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for cut in slices(part):
                rows = fn([cut.column(c).to_pylist() for c in columns])
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema
                    )

    return run


def ordered(
    work: Workspace, df: DataFrame, keys: list[Column], size: str | None = None
) -> DataFrame:
    """``df`` with ``pos`` (0, 1, ... in the order of ``keys``) and, for ``size``,
    ``before`` (sum of it over earlier rows).

    The rows are dealt by range and written; only a count and a sum of each
    partition meet, so no task sees more than its range. Keys should be unique:
    rows that tie get consecutive positions in an unspecified order, fixed by
    the written table.
    """
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    amount = F.col(size) if size else F.lit(0)
    rows = work.save(
        spread.select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
        ),
        "ordered",
    )
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(amount).alias("_s"))
    # one row for each partition: bounded by their number
    first, total, rank = {}, 0, 0
    for r in sorted(parts.collect(), key=lambda r: r["_part"]):
        first[r["_part"]] = (rank, total)
        rank, total = rank + r["_n"], total + (r["_s"] or 0)
    starts = work.spark.createDataFrame(
        [(p, a, float(b) if isinstance(b, float) else int(b)) for p, (a, b) in first.items()]
        or [(0, 0, 0)],
        "_part int, _rank long, _sum " + ("double" if isinstance(total, float) else "long"),
    )
    joined = rows.join(F.broadcast(starts), "_part")
    if size:
        from pyspark.sql import Window

        w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        joined = joined.withColumn(
            "before", F.col("_sum") + F.coalesce(F.sum(amount).over(w), F.lit(0))
        )
    return joined.withColumn("pos", F.col("_rank") + F.col("_at")).drop(
        "_part", "_at", "_rank", "_sum"
    )

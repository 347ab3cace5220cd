"""Pluggable extractors: one document row in, any number of rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from figureyard.functions.columns import ERROR_CHARS
from figureyard.session import materialised

DOCUMENTS, ROWS = 64, 1024  # handled together; rows after which a task hands them on


def extract_rows(
    documents: DataFrame, key: str, extractor: Callable[[dict], Iterable[dict]], schema: str
) -> tuple[DataFrame, DataFrame]:
    """Rows an extractor yields per document, and one error row per document it
    fails on. ``schema`` describes the yielded rows; the key column is added.

    Documents are spread evenly first, so that long ones do not pile up in the
    task that happened to read them. Python sees Arrow batches of documents and
    takes a few of them at a time; beyond these it holds one document's rows.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]
    key_type = documents.schema[key].dataType.simpleString()
    out_type = f"{key} {key_type}, error string, {schema}"
    out_schema = to_arrow_schema(T.StructType.fromDDL(out_type))

    def of_document(doc: dict) -> list[tuple]:
        try:
            return [(doc[key], None, *[r.get(n) for n in names]) for r in extractor(doc)]
        except Exception as exc:  # a broken document must not fail the job
            return [(doc[key], f"{type(exc).__name__}: {exc}", *[None] * len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), out_schema)], schema=out_schema)
            found.clear()
            return out

        found: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                for doc in batch.slice(at, DOCUMENTS).to_pylist():
                    found.extend(of_document(doc))
                    if len(found) >= ROWS:
                        yield flushed()
        if found:
            yield flushed()

    spread = documents.repartition(key)
    # written once: rows and errors must not run the extractor twice
    rows = materialised(spread.mapInArrow(run, out_type), "extracted")
    good = rows.filter(F.col("error").isNull()).drop("error")
    bad = rows.filter(F.col("error").isNotNull()).select(
        key, F.substring("error", 1, ERROR_CHARS).alias("error")
    )
    return good, bad

"""Documents to packed training sequences, in five stages.

Each stage takes what its predecessor wrote and works on all of it: quality rules
reject documents and clean lines, one document of each near-duplicate group stays,
personal data is generalised, sources are mixed to target weights (documents may
come twice), and the mix is packed. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from figureyard.llm import minhash, mixing, packing, pii, quality
from figureyard.llm.common import Workspace, table
from figureyard.llm.tokens import public_file
from figureyard.session import shared_path

TOKENIZER = "word_bpe_49k.json"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_spent: list[Workspace] = []


def stage(fn: Callable[[DataFrame], DataFrame]) -> Stage:
    """A stage that first removes what the stage before left in the shared folder:
    its result is written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _spent:
            _spent.pop().remove()
        with Workspace.recorded(_spent):
            return fn(docs)

    return run


def keep_quality(docs: DataFrame) -> DataFrame:
    return quality.clean(docs)


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of each group; five-word shingles, similarity 0.8."""
    return minhash.one_of_each(docs, k=5, percent=80)


def remove_personal_data(docs: DataFrame) -> DataFrame:
    return pii.sanitised(docs)


def mix_sources(docs: DataFrame) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, public_file(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", stage(keep_quality)),
    ("minhash_near_dedup", stage(keep_one_of_each_group)),
    ("pii", stage(remove_personal_data)),
    ("mixing", stage(mix_sources)),
    ("packing", stage(pack_sequences)),
]

# Tokenisation cannot be stated in SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        fn(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Jobs that remember one small value for each key in the state store.

The work of a micro-batch depends on its own keys only, never on how many came
before: state is read and written by key, kept by RocksDB outside the heap and
checkpointed with the offsets, so a restart goes on and a replay repeats itself.
Copies of a key are combined before the shuffle, so a key that holds most of a
micro-batch does not reach one task whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


@contextmanager
def on_rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of queries started inside lies on disk; only changes are uploaded."""
    before = {k: spark.conf.get(k, None) for k in (PROVIDER, CHANGELOG)}
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(CHANGELOG, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def first_arrivals(stream: DataFrame, key: str, arrival: str) -> DataFrame:
    """Rows whose ``key`` was never seen before: in a micro-batch the one with the
    smallest ``arrival``, over micro-batches the earliest. A null key is a key.

    An aggregation in the JVM, combined before the shuffle; run it in update mode.
    A micro-batch has one time, the same when it is replayed, by which a key's first
    row tells whether it came just now.
    """
    now = F.current_timestamp().alias("__at")
    row = F.struct(*[c for c in stream.columns if c != key])
    order = F.struct("__at", arrival)
    return (
        stream.select("*", now).groupBy(key)
        .agg(F.min_by(row, order).alias("__row"), F.min("__at").alias("__first"), F.max("__at").alias("__last"))
        .filter(F.col("__first") == F.col("__last"))
        .select(*[F.col(key) if c == key else F.col("__row")[c].alias(c) for c in stream.columns])
    )


def next_ranges(requests: DataFrame, user: str, chunk: int, total: int) -> DataFrame:
    """(user, low, high): which positions (above low, up to high) of a list of
    ``total`` a user gets for asking in a micro-batch; the state is how far the
    user has come. Asking twice in a micro-batch counts once; who has everything
    gets no row."""
    kind = requests.schema[user].dataType.simpleString()

    def local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p[[user]].drop_duplicates()

    def advance(who: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        for _ in parts:
            pass
        low = state.get[0] if state.exists else 0
        high = min(low + chunk, total)
        if high > low:
            state.update((high,))
            yield pd.DataFrame({user: [who[0]], "low": [low], "high": [high]})

    return (
        requests.mapInPandas(local, f"{user} {kind}").groupBy(user)
        .applyInPandasWithState(advance, f"{user} {kind}, low LONG, high LONG", "upto LONG", "append", GroupStateTimeout.NoTimeout)
    )

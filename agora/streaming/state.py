"""The state store of keyed operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Keyed state with values, maps and timers needs this store; it keeps state on disk.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_store(df: DataFrame) -> DataFrame:
    """df, its session set to the store; agora.session sets it as well, but a session of another's making may not."""
    df.sparkSession.conf.set(*STORE)
    return df

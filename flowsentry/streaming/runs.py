"""Streams over files, run to their present end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsentry.sources.tables import shared_path

#: Timers and typed state need this state store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "spark.sql.streaming.stateStore.rocksdb"
#: One bound for all state stores of an executor together; without it each has write buffers of its own.
_BOUNDS = {f"{_ROCKS}.boundedMemoryUsage": "true", f"{_ROCKS}.maxMemoryUsageMB": "256"}


def keyed_state(spark: SparkSession) -> None:
    """Make the session's streams keep their state in RocksDB, as the stateful processors need it, in bounded memory
    (unless the session has bounds of its own)."""
    spark.conf.set(_PROVIDER, ROCKS)
    for name, value in _BOUNDS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def run_to_end(stream: DataFrame, table: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that its source holds now, append its rows to a Parquet table in the shared folder, and give
    that table. With the table and checkpoint of an earlier run it goes on where that one ended."""
    spark = stream.sparkSession
    keyed_state(spark)
    table, checkpoint = table or shared_path(spark, "stream"), checkpoint or shared_path(spark, "stream-checkpoint")
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table).awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)

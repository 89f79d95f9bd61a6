"""State-store settings the stateful streams need."""

from __future__ import annotations

from pyspark.sql import SparkSession

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State lives on local disk with its changelog in the checkpoint folder, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")

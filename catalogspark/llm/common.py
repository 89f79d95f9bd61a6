"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogspark.session import ensure_checkpoint_dir

#: Blanks that separate words: space and the five control blanks.
BLANKS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Data is broadcast by request only when it is measured to take no more.
BROADCAST_BYTES = 64 << 20
#: Who wants to know of the tables that are written just now.
_LISTENING: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder as Parquet and read it back.

    Cuts the lineage with files that outlive any executor, keeps column pruning,
    and gives the planner measured sizes to choose joins by.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _LISTENING:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def listening(paths: list[str]) -> Iterator[None]:
    """Note the folders of the tables that are written meanwhile."""
    _LISTENING.append(paths)
    try:
        yield
    finally:
        _LISTENING.pop()


def release(spark: SparkSession, paths: list[str], keep: DataFrame) -> None:
    """Delete tables by their folders, except what ``keep`` itself reads."""
    read = keep.inputFiles() if paths else []
    for path in paths:
        if not any(path.rpartition("/")[2] in f for f in read):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bounded(df: DataFrame, bytes_of_row: Column) -> DataFrame:
    """``df`` to be broadcast when all its rows are measured to take at most BROADCAST_BYTES."""
    taken = df.agg(F.sum(bytes_of_row)).first()[0] or 0
    return F.broadcast(df) if taken <= BROADCAST_BYTES else df


def with_runtime_filters(spark: SparkSession) -> None:
    """Let Spark filter a scan by a Bloom filter of the join's small side at every size.

    It does so by itself from 10 GB on. The small side needs a filter of its own in the plan.
    """
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")


def text_of(column: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def unit_random(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone (52 bits of their MD5)."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def before(value: str, *keys: str, order: list) -> Column:
    """Sum of ``value`` over the rows ahead of this one within ``keys``."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))

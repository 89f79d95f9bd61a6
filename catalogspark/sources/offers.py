"""Offer events: batch and streaming sources, quality filter, synthetic generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogspark.schemas import OFFERS

MAX_BATCH_RECORDS = 100_000  # fixed value: records accepted per batch


def read_offers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(OFFERS).format(fmt).load(path)


def stream_offers(
    spark: SparkSession, path: str, fmt: str = "parquet", *, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(OFFERS).format(fmt)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def accept_offers(offers: DataFrame, *, max_batch_records: int = MAX_BATCH_RECORDS) -> DataFrame:
    """Well-formed offers of batches that respect the record limit; an oversized batch is refused whole."""
    sound = offers.filter(
        F.col("file_hash").rlike(r"\A[0-9a-f]{32}\z") & F.col("name").isNotNull() & (F.col("size") >= 0)
    )
    oversized = (
        offers.groupBy("batch_id").agg(F.count("*").alias("n"))
        .filter(F.col("n") > max_batch_records).select("batch_id")
    )
    return sound.join(oversized, "batch_id", "left_anti")


def generate_offers(
    spark: SparkSession, files: int, *, users: int | None = None, unique_percent: int = 70,
    words_per_name: int = 7, files_per_user: int = 614, vocabulary_percent: int = 72,
) -> DataFrame:
    """Synthetic catalog of the usual shape, generated in parallel and the same on every run."""
    users = users or max(files // files_per_user, 1)
    names = max(files * unique_percent // 100, 1)
    vocabulary = max(files * vocabulary_percent // 100, 1)
    i = F.col("id")
    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64(i % names, F.lit(k)), F.lit(vocabulary)).cast("string"))
    return spark.range(files).select(
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + i * 1000).alias("ts"),
        i.alias("seq"),
        F.floor(i / 200).cast("bigint").alias("batch_id"),
        F.concat(F.lit("s"), (i % users).cast("string")).alias("session_id"),
        F.md5(F.concat(F.lit("u"), (i % users).cast("string"))).alias("user_hash"),
        F.pmod(F.xxhash64(i % users, F.lit("ip")), F.lit(1 << 32)).alias("ip"),
        (F.pmod(F.xxhash64(i % users, F.lit("port")), F.lit(32768)) * 2 + 1).cast("int").alias("port"),
        F.md5(F.concat(F.lit("f"), i.cast("string"))).alias("file_hash"),
        F.lit(0xFBFBFBFB).cast("bigint").alias("client_id"),
        F.lit(0xFBFB).cast("int").alias("client_port"),
        F.concat(F.concat_ws(" ", *[word(k) for k in range(words_per_name)]), F.lit(".bin")).alias("name"),
        F.pmod(F.xxhash64(i, F.lit("size")), F.lit(1 << 40)).alias("size"),
    )

"""Catalog build: files, sources, departures, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalogspark.functions.ordered import MICROS, first_per_key

# Total order of offers; equal offers give equal results.
ORDER = ["ts", "seq", "user_hash", "file_hash", "name", "complete"]

# Marker pair a client sends for a file it does not hold completely.
PARTIAL_CLIENT_ID, PARTIAL_PORT = 0xFCFCFCFC, 0xFCFC


def order_key(columns: list[str] = ORDER) -> Column:
    return F.struct(*columns)


def with_complete(offers: DataFrame) -> DataFrame:
    """Add ``complete``: false for the partial marker pair, else true."""
    partial = (F.col("client_id") == PARTIAL_CLIENT_ID) & (F.col("client_port") == PARTIAL_PORT)
    return offers.withColumn("complete", F.when(partial, F.lit(False)).otherwise(F.lit(True)))


def files(offers: DataFrame) -> DataFrame:
    """One row per file: the first name and size win, ``last_seen`` is refreshed."""
    return (
        offers.groupBy("file_hash")
        .agg(
            F.min_by(F.struct("name", "size"), order_key()).alias("first"),
            F.max("ts").alias("last_seen"),
        )
        .select("file_hash", "first.name", "first.size", "last_seen")
    )


def sources(offers: DataFrame) -> DataFrame:
    """One row per (file, user): first address wins, the latest completeness counts."""
    # The order of offers, less what the group fixes.
    order = [c for c in ORDER if c not in ("file_hash", "user_hash")]
    return (
        offers.groupBy("file_hash", "user_hash")
        .agg(
            F.min(F.struct(*order, "ip", "port")).alias("first"),
            F.max(F.struct(*order)).getField("complete").alias("complete"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
        .select("file_hash", "user_hash", "first.ip", "first.port", "complete", "first_ts", "last_ts")
    )


def merge_files(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert: a stored row keeps its name and size and takes the later ``last_seen``."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    return (
        both.groupBy("file_hash")
        .agg(
            F.min_by(F.struct("name", "size"), "__new").alias("kept"),
            F.max("last_seen").alias("last_seen"),
        )
        .select("file_hash", "kept.name", "kept.size", "last_seen")
    )


def merge_sources(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert of sources: stored address wins, the fresh completeness wins."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    return (
        both.groupBy("file_hash", "user_hash")
        .agg(
            F.min_by(F.struct("ip", "port", "first_ts"), "__new").alias("kept"),
            F.max_by("complete", "__new").alias("complete"),
            F.max("last_ts").alias("last_ts"),
        )
        .select("file_hash", "user_hash", "kept.ip", "kept.port", "complete", "kept.first_ts", "last_ts")
    )


def files_per_user(source_rows: DataFrame) -> DataFrame:
    """Distinct files each user offers."""
    return source_rows.groupBy("user_hash").agg(F.count_distinct("file_hash").alias("files"))


def over_limit_users(source_rows: DataFrame, limit: int) -> DataFrame:
    return files_per_user(source_rows).filter(F.col("files") > limit)


def remove_users(
    file_rows: DataFrame, source_rows: DataFrame, departed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Drop the departed users' sources, then the files left without any source."""
    kept = source_rows.join(departed.select("user_hash"), "user_hash", "left_anti")
    return file_rows.join(kept.select("file_hash"), "file_hash", "left_semi"), kept


def orphans(file_rows: DataFrame, source_rows: DataFrame) -> DataFrame:
    """Files no one offers any more."""
    return file_rows.join(source_rows.select("file_hash"), "file_hash", "left_anti")


def evict_orphans(
    file_rows: DataFrame, source_rows: DataFrame, *, as_of: Column, grace_seconds: int
) -> DataFrame:
    """Files to keep: still offered, or last seen within the grace period."""
    known = source_rows.select("file_hash").distinct().withColumn("__offered", F.lit(True))
    fresh = F.unix_micros("last_seen") > F.unix_micros(as_of) - grace_seconds * MICROS
    return (
        file_rows.join(known, "file_hash", "left")
        .filter(F.col("__offered").isNotNull() | fresh)
        .drop("__offered")
    )


def purge_reverse_index(user_files: DataFrame, removed_files: DataFrame) -> DataFrame:
    """User-to-file rows without the removed files; emptied users vanish with their rows."""
    return user_files.join(removed_files.select("file_hash"), "file_hash", "left_anti")


def source_counts(source_rows: DataFrame) -> DataFrame:
    """Per file: all sources, and those known complete.

    ``complete_sources`` repeats the total, as clients of the catalog expect;
    ``complete_true`` is the real number.
    """
    counted = source_rows.groupBy("file_hash").agg(
        F.count("*").alias("sources"), F.count_if("complete").alias("complete_true")
    )
    return counted.select("file_hash", "sources", F.col("sources").alias("complete_sources"), "complete_true")


def expire(df: DataFrame, ts: str, ttl_seconds: int, as_of: Column) -> DataFrame:
    """Rows younger than their time to live."""
    return df.filter(F.unix_micros(as_of) - F.unix_micros(ts) < ttl_seconds * MICROS)


def capped_admission(events: DataFrame, key: str, ts: str, cap: int) -> DataFrame:
    """Events of the first ``cap`` keys ever seen; later keys are refused, known ones go on."""
    admitted = (
        events.groupBy(key).agg(F.min(ts).alias("__first")).orderBy("__first", key).limit(cap).select(key)
    )
    return events.join(admitted, key, "left_semi")


def effective_departures(sessions: DataFrame, disconnects: DataFrame) -> DataFrame:
    """Users whose latest session ended; the end of an older session changes nothing."""
    latest = sessions.groupBy("user_hash").agg(
        F.max_by("session_id", F.struct("login_ts", "session_id")).alias("session_id")
    )
    return disconnects.join(latest, ["user_hash", "session_id"], "left_semi").select("user_hash").distinct()


def first_sources(source_rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` sources of every file in order of arrival."""
    return first_per_key(source_rows, ["file_hash"], ["first_ts", "user_hash"], n)


def write_bucketed(rows: DataFrame, table: str, *, key: str, buckets: int, sort: list[str] | None = None) -> None:
    """Save a table bucketed by its key. Joins and groupings of such tables on the key do not shuffle."""
    (
        rows.repartition(buckets, key).write.mode("overwrite").format("parquet")
        .bucketBy(buckets, key).sortBy(*(sort or [key])).saveAsTable(table)
    )

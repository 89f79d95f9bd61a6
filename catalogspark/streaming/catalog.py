"""Continuous catalog: offers in; files, sources, postings and blocks out.

Every micro-batch is screened and reduced, and its small result is written to a
folder of its own, so a repeated batch overwrites itself and no batch rewrites the
table. Readers merge the pieces; the merge is associative, so compaction may fold
old pieces into a base at any time.

Disconnects are a second stream. They are written as tombstones (user, session, instant),
and source pieces are kept by session, so the two streams need not arrive in step. A
tombstone holds when its session is the user's latest one at its instant: the end of an
older session changes nothing. It removes the user's pieces whose last offer is not later.
Files and postings of which no source is left go with them. Compaction drops removed pieces, but no
session, for a tombstone may still arrive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from catalogspark.functions.ordered import running, slot
from catalogspark.operators import catalog, index
from catalogspark.operators.catalog import ORDER, order_key
from catalogspark.operators.screen import Policy, blocked_names, screen_repeated

KINDS = ("files", "sources", "sessions", "blocks")
CHUNK_SECONDS = 30 * 86_400  # a user's sessions are ordered in chunks of so much time
FEW_NAMES = 400_000  # names with a verdict, of some 100 bytes, that go to a batch's offers; of more, both are shuffled
DEPARTURES = "user_hash string, session_id string, ts timestamp"


def _key(*fixed: str) -> Column:
    """The order of offers, less what the group fixes: pieces hold and move it twice."""
    return order_key([c for c in ORDER if c not in fixed]).alias("key")


def _file_pieces(allowed: DataFrame) -> DataFrame:
    return allowed.groupBy("file_hash").agg(
        F.min(F.struct(_key("file_hash"), "name", "size")).alias("first"), F.max("ts").alias("last_seen")
    )


def _source_pieces(allowed: DataFrame) -> DataFrame:
    return allowed.groupBy("file_hash", "user_hash", "session_id").agg(
        F.min(F.struct(_key("file_hash", "user_hash"), "ip", "port")).alias("first"),
        F.max(F.struct(_key("file_hash", "user_hash"))).alias("latest"),
    )


def merge_file_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("file_hash").agg(F.min("first").alias("first"), F.max("last_seen").alias("last_seen"))


def merge_source_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("file_hash", "user_hash").agg(
        F.min("first").alias("first"), F.max("latest").alias("latest")
    )


def merge_sessions(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("user_hash", "session_id").agg(F.min("started").alias("started"))


def last_departures(sessions: DataFrame, departures: DataFrame) -> DataFrame:
    """(user_hash, gone_ts): the latest tombstone of each user that holds."""
    starts = sessions.select("user_hash", F.unix_micros("started").alias("us"), F.lit(False).alias("is_end"), "session_id")
    ends = departures.select("user_hash", F.unix_micros("ts").alias("us"), F.lit(True).alias("is_end"), "session_id")
    # Starts come before ends of their instant.
    events = starts.unionByName(ends).withColumn("chunk", slot(F.col("us"), CHUNK_SECONDS))
    started = F.when(~F.col("is_end"), F.struct("us", "session_id"))
    seen = running(events, keys=["user_hash"], chunk="chunk", order=["us", "is_end", "session_id"], aggs={"latest": ("max", started)})
    holds = seen.filter(F.col("is_end") & (F.col("latest.session_id") == F.col("session_id")))
    return holds.groupBy("user_hash").agg(F.timestamp_micros(F.max("us")).alias("gone_ts"))


def surviving(pieces: DataFrame, gone: DataFrame) -> DataFrame:
    """Source pieces merged by session, without those that a tombstone removes. They move once, to their user."""
    judged = pieces.join(gone, "user_hash", "left")
    merged = judged.groupBy("user_hash", "file_hash", "session_id").agg(
        F.min("first").alias("first"), F.max("latest").alias("latest"), F.max("gone_ts").alias("gone_ts")
    )
    return merged.filter(F.col("gone_ts").isNull() | (F.col("latest.key.ts") > F.col("gone_ts"))).drop("gone_ts")


def write_batch(batch: DataFrame, batch_id: int, root: str, policy: Policy) -> None:
    """One micro-batch under one policy version.

    Its offers move once, to their file: the few names with a verdict go to them, and pieces are made where they are.
    """
    rows = catalog.with_complete(batch)
    names = blocked_names(rows, policy).persist()
    few = names.count() <= FEW_NAMES
    screened = screen_repeated(rows, policy, F.broadcast(names) if few else names, by_file=True).persist()
    try:
        allowed = screened.filter(F.col("layer").isNull())
        parts = {
            "files": _file_pieces(allowed),
            "sources": _source_pieces(allowed),
            "sessions": screened.groupBy("user_hash", "session_id").agg(F.min("ts").alias("started")),
            "blocks": screened.filter(F.col("layer").isNotNull()),
        }
        for kind in KINDS:
            parts[kind].write.mode("overwrite").parquet(f"{root}/{kind}/batch={batch_id}")
    finally:
        screened.unpersist()
        names.unpersist()


def run_catalog(
    offers: DataFrame, root: str, checkpoint: str, policy: Callable[[], Policy], *, once: bool = False,
    shape: Callable[[DataFrame], DataFrame] = lambda batch: batch,
) -> StreamingQuery:
    """Start the stream; ``policy`` is asked for the current version at every micro-batch.

    Where the stream is of narrower rows, ``shape`` makes the offers of a micro-batch of them: laid out by file, they then stay there.
    """
    writer = (
        offers.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: write_batch(shape(batch), batch_id, root, policy()))
    )
    return writer.trigger(availableNow=True).start() if once else writer.start()


def run_departures(departures: DataFrame, root: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Start the stream of disconnects (user_hash, session_id, ts). One that is repeated changes nothing, so it may stay."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("user_hash", "session_id", "ts")
        rows.write.mode("overwrite").parquet(f"{root}/departures/batch={batch_id}")

    writer = departures.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def _base(spark: SparkSession, root: str, kind: str) -> int:
    try:
        return spark.read.parquet(f"{root}/{kind}_log").agg(F.max("upto")).head()[0]
    except AnalysisException:
        return -1


def _pieces(spark: SparkSession, root: str, kind: str) -> DataFrame:
    upto = _base(spark, root, kind)
    fresh = spark.read.parquet(f"{root}/{kind}").filter(F.col("batch") > upto).drop("batch")
    if upto < 0:
        return fresh
    return spark.read.parquet(f"{root}/{kind}_base/upto={upto}").unionByName(fresh)


def read_departures(spark: SparkSession, root: str) -> DataFrame:
    """Tombstones so far; none before the first disconnect."""
    try:
        return spark.read.parquet(f"{root}/departures").drop("batch")
    except AnalysisException:
        return spark.createDataFrame([], DEPARTURES)


def _source_pieces_left(spark: SparkSession, root: str) -> DataFrame:
    sessions = merge_sessions(_pieces(spark, root, "sessions"))
    return surviving(_pieces(spark, root, "sources"), last_departures(sessions, read_departures(spark, root)))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Files with a source. The first name and size ever offered stay."""
    merged = merge_file_pieces(_pieces(spark, root, "files"))
    alive = _source_pieces_left(spark, root).select("file_hash")
    return merged.join(alive, "file_hash", "left_semi").select("file_hash", "first.name", "first.size", "last_seen")


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    merged = merge_source_pieces(_source_pieces_left(spark, root))
    return merged.select(
        "file_hash", "user_hash", "first.ip", "first.port", F.col("latest.key.complete").alias("complete"),
        F.col("first.key.ts").alias("first_ts"), F.col("latest.key.ts").alias("last_ts"),
    )


def read_named_sources(spark: SparkSession, root: str) -> DataFrame:
    """Sources with their file's name. A file with a source is one that ``read_files`` keeps, so the sources are read once."""
    names = merge_file_pieces(_pieces(spark, root, "files")).select("file_hash", F.col("first.name").alias("name"))
    return read_sources(spark, root).join(names, "file_hash")


def read_postings(spark: SparkSession, root: str) -> DataFrame:
    return index.postings(read_files(spark, root))


def read_blocks(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/blocks").drop("batch")


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """Fold the pieces up to a batch into a base, without those that tombstones remove; the log entry comes last."""
    # Sessions decide which tombstones hold, so sources are folded while all sessions are still read.
    gone = last_departures(merge_sessions(_pieces(spark, root, "sessions")), read_departures(spark, root))
    merges = {
        "files": merge_file_pieces,
        "sources": lambda pieces: surviving(pieces, gone),
        "sessions": merge_sessions,
    }
    for kind, merge in merges.items():
        before = _base(spark, root, kind)
        pieces = spark.read.parquet(f"{root}/{kind}").filter(F.col("batch").between(before + 1, upto)).drop("batch")
        if before >= 0:
            pieces = pieces.unionByName(spark.read.parquet(f"{root}/{kind}_base/upto={before}"))
        merge(pieces).write.mode("overwrite").parquet(f"{root}/{kind}_base/upto={upto}")
        spark.range(1).select(F.lit(upto).alias("upto")).write.mode("append").parquet(f"{root}/{kind}_log")

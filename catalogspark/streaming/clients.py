"""Sessions and fresh values as streams, by event time.

Both equal their batch forms (``operators.clients``) on replay when nothing is later than
``lateness``. State is bounded by time: a session is dropped when it is closed, an
observation when no request can need it any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalogspark.functions.ordered import MICROS


def stream_sessions(activity: DataFrame, *, idle_seconds: int, ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Closed sessions of each user from any activity channel: user_hash, started_us, ended_us, events.

    ``activity``: user_hash, ts. A session is closed when the watermark has passed its
    last activity by more than the limit.
    """
    # A session window ends before its gap is full; a pause of exactly the limit keeps a session open.
    gap = f"{idle_seconds * MICROS + 1} microseconds"
    closed = activity.withWatermark(ts, lateness).groupBy("user_hash", F.session_window(ts, gap).alias("session"))
    return closed.agg(
        F.unix_micros(F.min(ts)).alias("started_us"), F.unix_micros(F.max(ts)).alias("ended_us"), F.count("*").alias("events")
    ).drop("session")


def stream_fresh_value(
    probes: DataFrame, observations: DataFrame, *, tolerance_seconds: int, ts: str = "ts", lateness: str = "1 hour",
) -> DataFrame:
    """Newest observed value per probe if young enough and not zero, else the announced one.

    ``probes``: user_hash, ts, probe_id, announced. ``observations``: user_hash, ts, value. A
    join bounded in time on both sides; a probe is answered when the watermark has passed
    it, so that no newer observation can follow.
    """
    asked = probes.select(F.col("user_hash"), F.col(ts).alias("asked_ts"), "probe_id", "announced").withWatermark("asked_ts", lateness)
    seen = observations.select(F.col("user_hash").alias("seen_user"), F.col(ts).alias("seen_ts"), "value").withWatermark("seen_ts", lateness)
    young = (F.col("user_hash") == F.col("seen_user")) & (F.col("seen_ts") <= F.col("asked_ts")) & (
        F.col("seen_ts") > F.col("asked_ts") - F.expr(f"interval {tolerance_seconds} seconds"))
    met = asked.join(seen, young, "left_outer")
    newest = met.groupBy("user_hash", "probe_id", "announced", "asked_ts").agg(F.max(F.struct("seen_ts", "value")).alias("last"))
    value = F.when(F.col("last.value") != 0, F.col("last.value"))
    return newest.select(
        "user_hash", "probe_id", F.unix_micros("asked_ts").alias("at_us"), "announced", F.coalesce(value, F.col("announced")).alias("effective"))

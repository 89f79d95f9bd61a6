"""Query floods, timed bans, repeat suppression, recent keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalogspark.functions.ordered import MICROS, greedy_spacing, running, slot
from catalogspark.session import cut_lineage


@dataclass(frozen=True)
class FloodLimits:
    """Detector settings; rates are per minute. Defaults are the fixed production values."""

    window_seconds: int = 60
    min_samples: int = 30
    rate: float = 200.0
    flood_rate: float = 600.0
    stddev_ms: float = 50.0
    cooldown_seconds: int = 30
    ban_seconds: int = 86_400


def _overlapping_chunks(events: DataFrame, window_seconds: int) -> DataFrame:
    """Cut each address's time line into chunks as long as the window.

    An event can be in the window of an event of its own chunk or of the next one,
    so it is placed in both; in the next chunk it is only context.
    """
    own = slot(F.col("at_us"), window_seconds)
    return events.withColumn("__own", own).withColumn(
        "__chunk", F.explode(F.array(F.col("__own"), F.col("__own") + 1))
    )


def sliding_rates(events: DataFrame, limits: FloodLimits = FloodLimits()) -> DataFrame:
    """Per event (ip, at_us): samples in the window, rate per minute, deviation of the intervals in ms.

    Both window ends are included. The deviation is that of the population of gaps
    between neighbours inside the window: the first event's own gap lies outside.
    """
    placed = _overlapping_chunks(events, limits.window_seconds)
    line = Window.partitionBy("ip", "__chunk").orderBy("at_us")
    recent = line.rangeBetween(-limits.window_seconds * MICROS, 0)
    gap_ms = (F.col("at_us") - F.lag("at_us").over(line)) / 1000.0
    squares = placed.withColumn("__sq", F.coalesce(gap_ms * gap_ms, F.lit(0.0)))
    measured = squares.select(
        "*",
        F.count("*").over(recent).alias("samples"),
        F.min("at_us").over(recent).alias("__first"),
        (F.sum("__sq").over(recent) - F.first("__sq").over(recent)).alias("__sum_sq"),
    ).filter(F.col("__own") == F.col("__chunk"))
    span_ms = (F.col("at_us") - F.col("__first")) / 1000.0
    gaps = F.col("samples") - 1
    variance = F.col("__sum_sq") / gaps - F.pow(span_ms / gaps, F.lit(2.0))
    return measured.select(
        *events.columns,
        "samples",
        (F.col("samples") / F.greatest(span_ms / 1000.0, F.lit(0.001)) * 60.0).alias("qpm"),
        F.when(gaps > 0, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("stddev_ms"),
    )


def verdict(limits: FloodLimits = FloodLimits()) -> Column:
    """'flood', 'uniform' or null for a measured event."""
    enough = F.col("samples") >= limits.min_samples
    return (
        F.when(enough & (F.col("qpm") > limits.flood_rate), "flood")
        .when(
            enough & (F.col("qpm") > limits.rate) & (F.col("stddev_ms") < limits.stddev_ms), "uniform"
        )
    )


def flood_events(events: DataFrame, limits: FloodLimits = FloodLimits()) -> DataFrame:
    """Events at which the detector would fire, without cooldown or bans."""
    return sliding_rates(events, limits).withColumn("reason", verdict(limits)).filter(
        F.col("reason").isNotNull()
    )


def cooled_detections(detected: DataFrame, *, seq: str, cooldown_seconds: int) -> DataFrame:
    """At most one detection per address per cooldown, counted from the last one kept."""
    spaced = greedy_spacing(detected, keys=["ip"], ts_us="at_us", seq=seq, gap_seconds=cooldown_seconds)
    return spaced.filter("kept").drop("kept")


def timed_bans(events: DataFrame, limits: FloodLimits = FloodLimits()) -> DataFrame:
    """Bans with suppression: what a banned address sends is dropped and never counted later.

    Returns (ip, at_us, samples, qpm, stddev_ms, reason), one row per ban. After a
    ban the address starts again with an empty window, so each round finds the
    next ban of every address that was banned in the round before, over ordinary
    sliding windows. The rounds are bounded by the time span over the ban length.
    """
    live = events.select("ip", "at_us")
    found: DataFrame | None = None
    while True:
        next_ban = cut_lineage(
            flood_events(live, limits)
            .groupBy("ip")
            .agg(F.min_by(F.struct("at_us", "samples", "qpm", "stddev_ms", "reason"), "at_us").alias("b"))
            .select("ip", "b.*")
        )
        found = next_ban if found is None else found.unionByName(next_ban)
        if next_ban.isEmpty():
            return found
        resumes = next_ban.select("ip", (F.col("at_us") + limits.ban_seconds * MICROS).alias("__resumes"))
        live = (
            events.select("ip", "at_us").join(resumes, "ip")
            .filter(F.col("at_us") >= F.col("__resumes")).drop("__resumes")
        )


def without_banned(events: DataFrame, bans: DataFrame, *, ban_seconds: int) -> DataFrame:
    """Events that are not inside a ban of their address. The banning event itself is kept."""
    line = (
        bans.select("ip", "at_us", F.lit(1).alias("__after"), F.col("at_us").alias("__ban"))
        .unionByName(events.withColumn("__after", F.lit(0)), allowMissingColumns=True)
        .withColumn("__chunk", slot(F.col("at_us"), 86_400))
    )
    # At one instant events come before the ban they caused.
    latest = running(
        line, keys=["ip"], chunk="__chunk", order=["at_us", "__after"], peers=True,
        aggs={"__since": ("max", F.col("__ban"))},
    )
    inside = F.coalesce(F.col("at_us") - F.col("__since") < ban_seconds * MICROS, F.lit(False))
    return latest.filter((F.col("__after") == 0) & ~inside).select(*events.columns)


def detections(bans: DataFrame) -> DataFrame:
    """One record per address: first and last detection, count, the latest measurements."""
    return bans.groupBy("ip").agg(
        F.min("at_us").alias("first_seen_us"),
        F.max("at_us").alias("last_seen_us"),
        F.count("*").alias("query_count"),
        F.max_by(F.struct("qpm", "stddev_ms", "reason"), "at_us").alias("l"),
    ).select(
        "ip", "first_seen_us", "last_seen_us", "query_count",
        F.col("l.qpm").alias("qpm"), F.col("l.stddev_ms").alias("interval_stddev_ms"), "l.reason",
    )


def ban_transitions(bans: DataFrame) -> DataFrame:
    """How often an address went from free to banned."""
    return bans.agg(F.count("*").alias("transitions"), F.count_distinct("ip").alias("ips"))


def suppress_repeats(
    events: DataFrame, *, keys: list[str], seq: str, window_seconds: int
) -> DataFrame:
    """Events that pass, each with the number suppressed since the previous one that passed."""
    marked = greedy_spacing(events, keys=keys, ts_us="at_us", seq=seq, gap_seconds=window_seconds)
    numbered = running(
        marked.withColumn("__day", slot(F.col("at_us"), 86_400)),
        keys=keys, chunk="__day", order=["at_us", seq],
        aggs={"pass_no": ("sum", F.col("kept").cast("bigint"))},
    )
    passes = numbered.groupBy(*keys, "pass_no").agg(
        F.min("at_us").alias("at_us"), (F.count("*") - 1).alias("__held")
    )
    order = Window.partitionBy(*keys).orderBy("pass_no")
    return passes.select(
        *keys, "pass_no", "at_us",
        F.coalesce(F.lag("__held").over(order), F.lit(0)).alias("suppressed"),
    )


def recent_keys(events: DataFrame, *, key: str, as_of_us: Column, ttl_seconds: int) -> DataFrame:
    """Keys seen within the time to live."""
    return (
        events.groupBy(key).agg(F.max("at_us").alias("last_seen_us"))
        .filter(as_of_us - F.col("last_seen_us") < ttl_seconds * MICROS)
    )


def snapshots(events: DataFrame, *, period_seconds: int) -> DataFrame:
    """Per period with activity: distinct users and events so far in that period."""
    return events.groupBy((slot(F.col("at_us"), period_seconds) * period_seconds).alias("period_start")).agg(
        F.count_distinct("user_hash").alias("users"), F.count("*").alias("events")
    )

"""Streaming forms of flood detection, timed bans, repeat suppression, recent keys, snapshots.

On a replay in time order they give what the batch forms give. State per key is
bounded by the window: a flooding address is banned, and a banned address keeps
one number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from catalogspark.functions.ordered import MICROS
from catalogspark.operators.traffic import FloodLimits
from catalogspark.streaming.state import use_rocksdb


def measure(times: np.ndarray) -> tuple[float, float]:
    """Rate per minute and deviation of the intervals in ms of one window, oldest first."""
    span_ms = (times[-1] - times[0]) / 1000.0
    qpm = len(times) / max(span_ms / 1000.0, 0.001) * 60.0
    return qpm, float(np.std(np.diff(times) / 1000.0))


class FloodDetector(StatefulProcessor):
    """Per address: the events of the current window, and until when it is banned."""

    def __init__(self, limits: FloodLimits, expire: bool):
        self.limits, self.expire = limits, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Nothing older than a ban or a window matters.
        longest = max(self.limits.ban_seconds, self.limits.window_seconds)
        ttl = (longest + 1) * 1000 if self.expire else None
        self.recent = handle.getValueState("recent", "times array<bigint>", ttl)
        self.banned = handle.getValueState("banned", "until_us bigint", ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limits = self.limits
        window, ban = limits.window_seconds * MICROS, limits.ban_seconds * MICROS
        times = np.sort(np.concatenate([pdf["at_us"].to_numpy(dtype=np.int64) for pdf in rows]))
        held = list(self.recent.get()[0]) if self.recent.exists() else []
        until = self.banned.get()[0] if self.banned.exists() else None
        out, at = [], 0
        while at < len(times):
            if until is not None and times[at] < until:
                at = int(np.searchsorted(times, until, side="left"))
                continue
            now = int(times[at])
            held.append(now)
            held = held[int(np.searchsorted(held, now - window, side="left")):]
            at += 1
            if len(held) < limits.min_samples:
                continue
            qpm, stddev = measure(np.asarray(held))
            reason = (
                "flood" if qpm > limits.flood_rate
                else "uniform" if qpm > limits.rate and stddev < limits.stddev_ms
                else None
            )
            if reason is not None:
                out.append((key[0], now, len(held), qpm, stddev, reason))
                until, held = now + ban, []
        self.recent.update((held,))
        if until is not None:
            self.banned.update((until,))
        yield pd.DataFrame(out, columns=["ip", "at_us", "samples", "qpm", "stddev_ms", "reason"])

    def close(self) -> None:
        pass


def stream_bans(
    events: DataFrame, limits: FloodLimits = FloodLimits(), *, expire: bool = True
) -> DataFrame:
    """Bans as they happen; ``events``: ip, at_us.

    ``expire`` drops the state of addresses that have been quiet for longer than any
    ban. It goes by the clock, so a replay of old events must run without it.
    """
    use_rocksdb(events.sparkSession)
    return events.select("ip", "at_us").groupBy("ip").transformWithStateInPandas(
        statefulProcessor=FloodDetector(limits, expire),
        outputStructType="ip bigint, at_us bigint, samples bigint, qpm double, stddev_ms double, reason string",
        outputMode="Append",
        timeMode="ProcessingTime" if expire else "None",
    )


class RepeatFilter(StatefulProcessor):
    """Per key: when an event last passed, and how many were held back since."""

    def __init__(self, keys: list[str], window_seconds: int):
        self.keys, self.window = keys, window_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at_us bigint, held bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([pdf["at_us"].to_numpy(dtype=np.int64) for pdf in rows]))
        last, held = self.last.get() if self.last.exists() else (None, 0)
        out, at = [], 0
        while at < len(times):
            if last is None or times[at] - last >= self.window:
                out.append((*key, int(times[at]), held))
                last, held = int(times[at]), 0
                at += 1
            else:
                free = int(np.searchsorted(times, last + self.window, side="left"))
                held, at = held + free - at, free
        self.last.update((last, held))
        yield pd.DataFrame(out, columns=[*self.keys, "at_us", "suppressed"])

    def close(self) -> None:
        pass


def stream_suppressed(events: DataFrame, *, keys: list[str], window_seconds: int) -> DataFrame:
    """Events that pass, each with the number held back before it."""
    use_rocksdb(events.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", at_us bigint, suppressed bigint"
    return events.select(*keys, "at_us").groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=RepeatFilter(keys, window_seconds),
        outputStructType=schema, outputMode="Append", timeMode="None",
    )


def stream_recent_keys(events: DataFrame, *, key: str, ts: str, ttl: str) -> DataFrame:
    """A key when it is first seen, and again only after the time to live has passed."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key]).select(key, ts)


def stream_snapshots(events: DataFrame, *, ts: str, period: str, lateness: str) -> DataFrame:
    """Users (estimated) and events per period, given out once the period can no longer change."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.window(ts, period))
        .agg(F.approx_count_distinct("user_hash", 0.01).alias("users"), F.count("*").alias("events"))
        .select(F.unix_seconds("window.start").alias("period_start"), "users", "events")
    )

"""Streaming publisher ledger: distinct blocked files in a window, bans as they happen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from catalogspark.functions.ordered import MICROS
from catalogspark.streaming.state import use_rocksdb


class PublisherLedger(StatefulProcessor):
    """Per user: first catch of each file since the last long pause, and the catches of the window."""

    def __init__(self, window_seconds: int, retention_seconds: int, threshold: int):
        self.window, self.retention = window_seconds * MICROS, retention_seconds * MICROS
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "file_hash string", "caught_us bigint")
        self.recent = handle.getValueState("recent", "times array<bigint>, last_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        caught = pd.concat(list(rows)).sort_values(["caught_us", "file_hash"])
        times, last = self.recent.get() if self.recent.exists() else ([], None)
        times, out = list(times), []
        for now, group in caught.groupby("caught_us", sort=True):
            now = int(now)
            if last is not None and now - last > self.retention:
                self.files.clear()
                times = []
            for file_hash in group["file_hash"].unique():
                if not self.files.containsKey((file_hash,)):
                    self.files.updateValue((file_hash,), (now,))
                    times.append(now)
            times = [t for t in times if now - t <= self.window]
            last = now
            if len(times) > self.threshold:
                out.append((key[0], now, len(times)))
        self.recent.update((times, last))
        yield pd.DataFrame(out, columns=["user_hash", "caught_us", "in_window"])

    def close(self) -> None:
        pass


def stream_ban_marks(
    caught: DataFrame, *, window_seconds: int, retention_seconds: int, threshold: int
) -> DataFrame:
    """Instants at which a user's ban starts or is renewed; ``caught``: user_hash, file_hash, caught_us."""
    use_rocksdb(caught.sparkSession)
    return caught.select("user_hash", "file_hash", "caught_us").groupBy("user_hash").transformWithStateInPandas(
        statefulProcessor=PublisherLedger(window_seconds, retention_seconds, threshold),
        outputStructType="user_hash string, caught_us bigint, in_window bigint",
        outputMode="Append", timeMode="None",
    )

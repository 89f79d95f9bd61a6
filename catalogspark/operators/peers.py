"""Peer directory curation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalogspark.functions.net import is_public_peer
from catalogspark.functions.ordered import MICROS

DIRECTORY_CAP = 2048
HANDOUT_CAP = 255


def admit(
    advertised: DataFrame, client_ips: DataFrame, *, own: tuple[int, int] | None = None,
    cap: int = DIRECTORY_CAP,
) -> DataFrame:
    """Distinct advertised peers worth keeping, the first ``cap`` by time of arrival.

    ``advertised``: ip, port, at_us. Non-public addresses, port 0, the directory
    itself and current or recent clients are refused.
    """
    usable = advertised.filter(is_public_peer(F.col("ip")) & (F.col("port") != 0))
    if own is not None:
        usable = usable.filter(~((F.col("ip") == own[0]) & (F.col("port") == own[1])))
    return (
        usable.groupBy("ip", "port").agg(F.min("at_us").alias("added_us"))
        .join(client_ips.select("ip"), "ip", "left_anti")
        .orderBy("added_us", "ip", "port")
        .limit(cap)
    )


def sweep(
    directory: DataFrame, verified: DataFrame, client_ips: DataFrame, *, as_of_us: Column,
    grace_seconds: int = 600, verified_ttl_seconds: int = 3600,
) -> DataFrame:
    """Directory after cleaning.

    A verified address stays (``verified``: ip, port, at_us, within its ttl). Others
    go when a client uses the address or when the grace period is over.
    """
    fresh = verified.filter(as_of_us - F.col("at_us") < verified_ttl_seconds * MICROS)
    known = fresh.groupBy("ip").agg(F.lit(True).alias("__verified"))
    used = client_ips.select("ip").distinct().withColumn("__client", F.lit(True))
    is_verified = F.col("__verified").isNotNull()
    waiting = F.col("__client").isNull() & (as_of_us - F.col("added_us") <= grace_seconds * MICROS)
    return (
        directory.join(known, "ip", "left").join(used, "ip", "left")
        .filter(is_verified | waiting)
        .select("ip", "port", "added_us", is_verified.alias("verified"))
    )


def handout(
    directory: DataFrame, verified: DataFrame, *, as_of_us: Column, ttl_seconds: int = 3600,
    cap: int = HANDOUT_CAP,
) -> DataFrame:
    """Peers given to clients: exactly this address and port verified within the ttl."""
    fresh = verified.filter(as_of_us - F.col("at_us") < ttl_seconds * MICROS)
    return (
        directory.join(fresh.select("ip", "port"), ["ip", "port"], "left_semi")
        .orderBy("added_us", "ip", "port")
        .limit(cap)
    )

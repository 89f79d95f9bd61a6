"""IP ranges: merging, membership, as-of lookup, hit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from catalogspark.functions.ordered import running

# Address space of one chunk: a /16, so there are at most 65 536 chunks.
BIN_BITS = 16


def _bin(column: str):
    return F.shiftright(column, BIN_BITS)


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Union of ranges: overlapping and adjacent ones become one.

    A range opens a group when it starts beyond the furthest end so far plus one.
    Within a /16 that is a window over distinct starts; across chunks it is the
    furthest end, and then the group number, carried forward.
    """
    base = (
        ranges.filter(F.col("range_start") <= F.col("range_end"))
        .groupBy("range_start").agg(F.max("range_end").alias("range_end"))
        .withColumn("bin", _bin("range_start"))
    )
    in_bin = Window.partitionBy("bin").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    earlier_bins = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = base.groupBy("bin").agg(F.max("range_end").alias("__end")).select(
        "bin", F.max("__end").over(earlier_bins).alias("__before")
    )
    opened = (
        base.withColumn("__here", F.max("range_end").over(in_bin))
        .join(bins, "bin", "left")
        .withColumn("__reach", F.greatest("__here", "__before"))
        .withColumn("__opens", F.coalesce(F.col("range_start") > F.col("__reach") + 1, F.lit(True)).cast("int"))
        .select("bin", "range_start", "range_end", "__opens")
    )
    numbered = running(
        opened, keys=[], chunk="bin", order=["range_start"], aggs={"grp": ("sum", F.col("__opens"))}
    )
    return (
        numbered.groupBy("grp")
        .agg(F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end"))
        .select("range_start", "range_end")
    )


def last_start_lookup(ips: DataFrame, ranges: DataFrame, *, payload: list[str]) -> DataFrame:
    """Distinct ``ip`` -> the last range starting at or before it, if it reaches the ip.

    Only that one range is tried, whatever wider ranges started earlier. An as-of
    join as a running "last range seen" over ranges and probes in address order,
    chunked by /16. Of ranges with the same start the one with the greatest end
    counts. Probes without a match are left out.
    """
    wanted = ["range_start", "range_end", *payload]
    lines = ranges.select(
        _bin("range_start").alias("bin"), F.col("range_start").alias("at"), F.lit(0).alias("is_probe"),
        F.struct(*wanted).alias("candidate"),
    )
    probes = ips.select("ip").distinct().select(
        _bin("ip").alias("bin"), F.col("ip").alias("at"), F.lit(1).alias("is_probe"),
    )
    line = lines.unionByName(probes, allowMissingColumns=True)
    seen = running(
        line, keys=[], chunk="bin", order=["at", "is_probe", "candidate"],
        aggs={"last": ("max", F.col("candidate"))},
    )
    return (
        seen.filter((F.col("is_probe") == 1) & (F.col("at") <= F.col("last.range_end")))
        .select(F.col("at").alias("ip"), "last.*")
    )


def blocked_ips(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct addresses covered by any range, with the merged range that covers them.

    Merged ranges are disjoint, so cutting them into /16 pieces adds at most 65 536
    rows and the interval join becomes an equi-join on the piece.
    """
    merged = merge_ranges(ranges)
    pieces = merged.select(
        "range_start", "range_end", F.explode(F.sequence(_bin("range_start"), _bin("range_end"))).alias("bin")
    )
    probes = ips.select("ip").distinct().withColumn("bin", _bin("ip"))
    return (
        probes.join(pieces, "bin")
        .filter(F.col("ip").between(F.col("range_start"), F.col("range_end")))
        .select("ip", "range_start", "range_end")
    )


def hit_counts(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Events per original range, counted on the range the lookup selects.

    Events are first reduced to one row per address.
    """
    per_ip = events.groupBy("ip").agg(F.count("*").alias("n"))
    found = last_start_lookup(per_ip, ranges, payload=[])
    return (
        per_ip.join(found, "ip")
        .groupBy("range_start", "range_end").agg(F.sum("n").alias("hits"))
    )


def connection_gate(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Events with ``blocked``: their address lies in a range."""
    hit = blocked_ips(events, ranges).select("ip", F.lit(True).alias("__hit"))
    return (
        events.join(hit, "ip", "left")
        .withColumn("blocked", F.coalesce("__hit", F.lit(False)))
        .drop("__hit")
    )


def with_country(events: DataFrame, geo_ranges: DataFrame, *, unknown: str = "??") -> DataFrame:
    """Events with ``country``; an address in a gap gets the unknown code."""
    found = last_start_lookup(events, geo_ranges, payload=["code"]).select("ip", F.col("code").alias("__code"))
    return (
        events.join(found, "ip", "left")
        .withColumn("country", F.coalesce("__code", F.lit(unknown)))
        .drop("__code")
    )

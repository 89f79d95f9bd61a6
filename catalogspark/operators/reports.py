"""Operator reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalogspark.functions.filetype import size_contradicts_extension
from catalogspark.functions.ordered import MICROS, first_per_key
from catalogspark.functions.text import words4_bytes
from catalogspark.operators.index import token_counts

NAME_CHARS = 120


def window_rows(rows: DataFrame, *, ts_us: str, since_us: Column | None) -> DataFrame:
    """Rows at or after the start of a review window; all of them without one."""
    return rows if since_us is None else rows.filter(F.col(ts_us) >= since_us)


def caught_names(first_catches: DataFrame) -> DataFrame:
    """The distinct names of every file with the earliest catch of each."""
    return first_catches.groupBy("file_hash", "name").agg(
        F.min(F.struct("caught_us", "user_hash", "layer", "reason", "size")).alias("first")
    )


def blocks_by_file(
    first_catches: DataFrame, *, names_shown: int = 12, per_name: DataFrame | None = None
) -> DataFrame:
    """One row per file: its earliest catch, all its distinct names counted, the first few listed.

    ``unrelated`` counts the names that share no long word with the earliest one;
    it is taken over all names, not over the listed ones. ``per_name`` may hold the ``caught_names``
    where they are kept: they are read three times, and far fewer than the catches.
    """
    per_name = caught_names(first_catches) if per_name is None else per_name
    leads = per_name.groupBy("file_hash").agg(
        F.min_by(F.struct("name", "first"), F.struct("first", "name")).alias("lead")
    )
    apart = ~F.arrays_overlap(words4_bytes(F.col("name")), words4_bytes(F.col("lead.name")))
    # A file has each name once; compared with all columns, so that Spark shuffles the catches once for all three uses.
    other = F.struct("name", "first") != F.col("lead")
    totals = (
        per_name.join(leads, "file_hash")
        .groupBy("file_hash", "lead")
        .agg(
            F.count("*").alias("name_count"),
            F.count_if(other & apart).alias("unrelated"),
        )
    )
    listed = first_per_key(per_name, ["file_hash"], ["first", "name"], names_shown)
    names = listed.groupBy("file_hash").agg(
        F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("ranked")
    )
    return totals.join(names, "file_hash").select(
        "file_hash",
        F.col("lead.first.layer").alias("layer"), F.col("lead.first.reason").alias("reason"),
        F.col("lead.first.size").alias("size"), F.col("lead.name").alias("name"),
        F.col("lead.first.caught_us").alias("caught_us"),
        "name_count", "unrelated", F.col("ranked.name").alias("names"),
    )


def review_csv_rows(by_file: DataFrame) -> DataFrame:
    """Review lines in their fixed column order; the name comes last and holds no separator."""
    return by_file.select(
        F.col("file_hash").alias("hash"),
        "layer",
        "reason",
        "size",
        F.when(size_contradicts_extension(F.col("name"), F.col("size")), "!").otherwise("").alias("sizeflag"),
        F.col("name_count").alias("names"),
        "unrelated",
        F.replace(F.col("name"), F.lit(";"), F.lit(",")).alias("name"),
    )


def by_cause(by_file: DataFrame, *, examples: int = 10, ban_layer: str = "L3") -> DataFrame:
    """Files per (layer, reason) with a few examples each. Ban-list hits are only counted elsewhere."""
    open_ = by_file.filter(F.col("layer") != ban_layer)
    sizes = open_.groupBy("layer", "reason").agg(F.count("*").alias("files"))
    shown = first_per_key(open_, ["layer", "reason"], ["file_hash"], examples)
    return shown.join(sizes, ["layer", "reason"]).select(
        "layer", "reason", "files", "rank", "file_hash",
        F.left(F.col("name"), F.lit(NAME_CHARS)).alias("name"),
        F.floor(F.col("size") / 1048576).alias("size_mb"),
        size_contradicts_extension(F.col("name"), F.col("size")).alias("size_flag"),
    )


def publisher_graph(
    first_catches: DataFrame, source_rows: DataFrame, bans: DataFrame, *, since_us: Column,
    min_flagged: int = 1,
) -> DataFrame:
    """Flagged users with recent catches: recent, total, still offered, banned, files offered now.

    ``min_flagged`` tests the total. Details are rows of ``flagged_detail`` and
    ``published_detail``.
    """
    distinct = first_catches.groupBy("user_hash", "file_hash").agg(F.max("caught_us").alias("caught_us"))
    live = source_rows.select("file_hash").distinct().withColumn("__live", F.lit(True))
    recent = F.col("caught_us") >= since_us
    flagged = (
        distinct.join(live, "file_hash", "left")
        .groupBy("user_hash")
        .agg(
            F.count_if(recent).alias("flagged_recent"),
            F.count("*").alias("flagged_total"),
            F.count_if(recent & F.col("__live").isNotNull()).alias("still_live"),
            F.max("caught_us").alias("last_flagged_us"),
        )
        .filter((F.col("flagged_total") >= min_flagged) & (F.col("flagged_recent") > 0))
    )
    published = source_rows.groupBy("user_hash").agg(F.count_distinct("file_hash").alias("published_now"))
    banned = bans.select("user_hash").distinct().withColumn("__banned", F.lit(True))
    return (
        flagged.join(banned, "user_hash", "left").join(published, "user_hash", "left")
        .select(
            "user_hash", "flagged_recent", "flagged_total", "still_live", "last_flagged_us",
            F.col("__banned").isNotNull().alias("banned"),
            F.coalesce("published_now", F.lit(0)).alias("published_now"),
        )
    )


def published_detail(
    graph: DataFrame, first_catches: DataFrame, file_rows: DataFrame, source_rows: DataFrame,
    *, max_files: int = 200, file_order: Column | None = None,
) -> DataFrame:
    """Up to ``max_files`` files each user of the graph offers now, flagged or not.

    They come in order of their hash, or of ``file_order`` where ``file_hash`` holds numbers for the hashes. Users are hashed for
    the join, so sources move to their user as they are, and the order is computed there.
    """
    offered = source_rows.join(graph.select("user_hash").hint("shuffle_hash"), "user_hash", "left_semi").select("user_hash", "file_hash")
    shown = first_per_key(offered, ["user_hash"], [F.col("file_hash") if file_order is None else file_order], max_files)
    flagged = first_catches.select("user_hash", "file_hash").distinct().withColumn("__flagged", F.lit(True))
    per_file = source_rows.groupBy("file_hash").agg(F.count("*").alias("sources"))
    return (
        shown.join(flagged, ["user_hash", "file_hash"], "left")
        .join(file_rows.select("file_hash", "name", "size"), "file_hash")
        .join(per_file, "file_hash")
        .select("user_hash", "rank", "file_hash", "name", "size", "sources",
                F.col("__flagged").isNotNull().alias("flagged"))
    )


def connected_clients(clients: DataFrame, *, as_of_us: Column) -> DataFrame:
    return clients.withColumn(
        "connected_seconds", F.floor((as_of_us - F.col("login_us")) / MICROS).cast("bigint")
    ).drop("login_us")


def clients_by(clients: DataFrame, column: str) -> DataFrame:
    """Clients per value, most frequent first."""
    return clients.groupBy(column).agg(F.count("*").alias("clients")).orderBy(F.desc("clients"), column)


def range_hits(hits: DataFrame, ranges: DataFrame, *, top: int = 500) -> DataFrame:
    """Ranges that caught traffic, with their description."""
    return (
        hits.join(ranges.select("range_start", "range_end", "description"), ["range_start", "range_end"])
        .orderBy(F.desc("hits"), "range_start")
        .limit(top)
    )


def bot_report(detected: DataFrame, bans: DataFrame, *, as_of_us: Column, ban_seconds: int) -> DataFrame:
    """Detections with the current ban state, fastest first; a value that is no number shows as 0."""
    running_bans = (
        bans.filter(as_of_us - F.col("at_us") < ban_seconds * MICROS).select("ip").distinct()
        .withColumn("__banned", F.lit(True))
    )
    clean = lambda c: F.when(F.isnan(c) | F.abs(c).isin(float("inf")), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return (
        detected.join(running_bans, "ip", "left")
        .withColumn("banned", F.col("__banned").isNotNull()).drop("__banned")
        .withColumn("qpm", clean(F.col("qpm")))
        .withColumn("interval_stddev_ms", clean(F.col("interval_stddev_ms")))
        .orderBy(F.desc("qpm"), "ip")
    )


def block_statistics(counters: DataFrame) -> DataFrame:
    return counters.orderBy(F.desc("blocked"), "counter")


def status(
    clients: DataFrame, file_rows: DataFrame, posting_rows: DataFrame, bans: DataFrame, outcomes: DataFrame
) -> DataFrame:
    """One row of headline numbers; every input is reduced to one row before the join."""
    return (
        clients.agg(
            F.count("*").alias("clients"),
            F.count_if(~F.col("is_high_id")).alias("low_id_clients"),
            F.count_if("natt_capable").alias("natt_capable"),
        )
        .crossJoin(file_rows.agg(F.count("*").alias("files")))
        .crossJoin(token_counts(posting_rows).agg(F.count("*").alias("keywords")))
        .crossJoin(bans.agg(F.count_distinct("ip").alias("banned")))
        .crossJoin(outcomes.agg(F.count_if(F.col("outcome") == "coordinated").alias("coordinated")))
    )


def catalog_shape(
    file_rows: DataFrame, source_rows: DataFrame, posting_rows: DataFrame, first_catches: DataFrame
) -> DataFrame:
    """One row of catalog sizes."""
    per_file = source_rows.groupBy("file_hash").agg(F.count("*").alias("n"))
    per_user = source_rows.groupBy("user_hash").agg(F.count("*").alias("n"))
    return (
        file_rows.agg(F.count("*").alias("files"), F.sum(F.octet_length("name")).alias("name_bytes"))
        .crossJoin(per_file.agg(F.sum("n").alias("sources_total"), F.max("n").alias("sources_max")))
        .crossJoin(per_user.agg(F.count("*").alias("users"), F.sum("n").alias("user_files")))
        .crossJoin(token_counts(posting_rows).agg(F.count("*").alias("keywords"), F.sum("postings").alias("postings")))
        .crossJoin(first_catches.agg(F.count_distinct("user_hash").alias("ledger_users")))
    )


def list_health(lists: dict[str, DataFrame]) -> DataFrame:
    """Entries per reference list; a list is in order when it has any."""
    parts = [
        df.agg(F.count("*").alias("entries")).select(
            F.lit(name).alias("list"), "entries", (F.col("entries") > 0).alias("ok")
        )
        for name, df in lists.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def latest_warnings(log: DataFrame, *, seq: str, kept: int = 200, shown: int = 100) -> DataFrame:
    """The newest warnings of the last ``kept``, and how many there were at all."""
    total = log.agg(F.count("*").alias("total_seen"))
    newest = log.orderBy(F.desc("at_us"), F.desc(seq)).limit(min(shown, kept))
    return newest.crossJoin(total)


def peer_table(peers: DataFrame, verified: DataFrame, keyed: DataFrame) -> DataFrame:
    """Peers with flags: verified, and with a known key."""
    seen = verified.select("ip").distinct().withColumn("__v", F.lit(True))
    keys = keyed.select("ip").distinct().withColumn("__k", F.lit(True))
    return (
        peers.join(seen, "ip", "left").join(keys, "ip", "left")
        .select("ip", "port", F.col("__v").isNotNull().alias("verified"), F.col("__k").isNotNull().alias("has_key"))
    )


def rendezvous_counters(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("requests"))

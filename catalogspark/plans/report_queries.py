"""Operator reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import enforce, index, ranges, reports, traffic
from catalogspark.plans import bindings as b
from catalogspark.plans.alias_queries import blocks_by_file
from catalogspark.plans.client_queries import AS_OF_US, latest_sessions, rendezvous, software
from catalogspark.plans.registry import query, view
from catalogspark.plans.screen_queries import block_counters
from catalogspark.plans.traffic_queries import advertised, directory, timed_bans, verified

SINCE_US = 978_307_200_000_000  # 2001-01-01 00:00:00 UTC

_FLAG = "regexp_matches(lower(name), '[.](pdf|jpg)$') AND size > 52428800"


@query("a8_review_lines", f"""
SELECT file_hash AS hash, layer, reason, size, CASE WHEN {_FLAG} THEN '!' ELSE '' END AS sizeflag, name_count AS names,
  unrelated, replace(name, ';', ',') AS name FROM v_by_file_names""")
def a8(spark, sf):
    return reports.review_csv_rows(blocks_by_file(spark, sf))


@query("a9_report_json", """
SELECT CAST(json_object('country', country, 'clients', count(*)) AS VARCHAR) AS line FROM v_clients GROUP BY country""")
def a9(spark, sf):
    return reports.clients_by(b.clients(spark, sf), "country").select(
        F.to_json(F.struct("country", "clients")).alias("line")
    )


@query("h1_review_window", f"""
SELECT layer, count(*) AS catches, min(caught_us) AS first_us FROM v_ledger WHERE caught_us >= {SINCE_US} GROUP BY layer""")
def h1(spark, sf):
    rows = reports.window_rows(b.ledger(spark, sf), ts_us="caught_us", since_us=F.lit(SINCE_US))
    return rows.groupBy("layer").agg(F.count("*").alias("catches"), F.min("caught_us").alias("first_us"))


@query("h2_blocks_by_file", """
SELECT file_hash, layer, reason, size, name, caught_us, name_count, unrelated, array_to_string(names, '|') AS names
FROM v_by_file_names""")
def h2(spark, sf):
    return blocks_by_file(spark, sf).withColumn("names", F.array_join("names", "|"))


@query("h3_by_cause", f"""
SELECT layer, reason, files, rank, file_hash, left(name, 120) AS name, size // 1048576 AS size_mb, {_FLAG} AS size_flag FROM (
  SELECT *, count(*) OVER (PARTITION BY layer, reason) AS files,
    CAST(row_number() OVER (PARTITION BY layer, reason ORDER BY file_hash) AS INTEGER) AS rank
  FROM v_by_file_names WHERE layer <> 'L3') WHERE rank <= 5""")
def h3(spark, sf):
    return reports.by_cause(blocks_by_file(spark, sf), examples=5)


view("v_graph", f"""
SELECT user_hash, count(*) FILTER (WHERE caught_us >= {SINCE_US}) AS flagged_recent, count(*) AS flagged_total,
  count(*) FILTER (WHERE caught_us >= {SINCE_US} AND file_hash IN (SELECT file_hash FROM v_sources)) AS still_live,
  max(caught_us) AS last_flagged_us
FROM (SELECT user_hash, file_hash, max(caught_us) AS caught_us FROM v_ledger GROUP BY ALL) GROUP BY user_hash
HAVING count(*) >= 3 AND count(*) FILTER (WHERE caught_us >= {SINCE_US}) > 0""")


def _graph(spark, sf):
    """By the numbers of users and files."""
    first = b.numbered_ledger(spark, sf)
    bans = enforce.publisher_bans(first, window_seconds=b.COUNT_WINDOW, threshold=b.THRESHOLD)
    return reports.publisher_graph(first, b.numbered_sources(spark, sf), bans, since_us=F.lit(SINCE_US), min_flagged=3)


@query("h4_publisher_graph", """
SELECT g.*, EXISTS (SELECT 1 FROM v_publisher_bans p WHERE p.user_hash = g.user_hash) AS banned,
  (SELECT count(*) FROM v_sources s WHERE s.user_hash = g.user_hash) AS published_now FROM v_graph g""")
def h4(spark, sf):
    return _graph(spark, sf).withColumn("user_hash", b.user_id("user_hash"))


@query("h4_published_files", """
SELECT user_hash, rank, r.file_hash, f.name, f.size, c.sources, EXISTS (SELECT 1 FROM v_ledger l
    WHERE l.user_hash = r.user_hash AND l.file_hash = r.file_hash) AS flagged
FROM (SELECT user_hash, file_hash, CAST(row_number() OVER (PARTITION BY user_hash ORDER BY file_hash) AS INTEGER) AS rank
  FROM v_sources WHERE user_hash IN (SELECT user_hash FROM v_graph)) r
JOIN v_files f ON f.file_hash = r.file_hash JOIN v_source_counts c ON c.file_hash = r.file_hash WHERE rank <= 200""")
def h4_published(spark, sf):
    shown = reports.published_detail(
        _graph(spark, sf), b.numbered_ledger(spark, sf), b.numbered_files(spark, sf), b.numbered_sources(spark, sf),
        max_files=200, file_order=F.unhex(b.file_id("file_hash")),
    )
    return shown.withColumns({"user_hash": b.user_id("user_hash"), "file_hash": b.file_id("file_hash")})


@query("h5_connected_clients", f"""
SELECT user_hash, ip, session_id, ({AS_OF_US} - login_ts) // 1000000 AS connected_seconds FROM v_latest_sessions""")
def h5(spark, sf):
    rows = latest_sessions(spark, sf).select("user_hash", "ip", "session_id", F.col("login_ts").alias("login_us"))
    return reports.connected_clients(rows, as_of_us=F.lit(AS_OF_US))


@query("h6_clients_by_software", "SELECT software, count(*) AS clients FROM v_software GROUP BY software")
def h6(spark, sf):
    return reports.clients_by(software(spark, sf), "software")


@query("h7_clients_by_country", "SELECT country, count(*) AS clients FROM v_clients GROUP BY country")
def h7(spark, sf):
    return reports.clients_by(b.clients(spark, sf), "country")


@query("h8_range_hits", """
SELECT range_start, range_end, hits, description FROM (
  SELECT range_start, range_end, description, count(*) AS hits FROM (
    SELECT q.ip, r.* FROM v_queries q ASOF JOIN v_ranges r ON q.ip >= r.range_start) WHERE ip <= range_end GROUP BY ALL)
ORDER BY hits DESC, range_start LIMIT 5""")
def h8(spark, sf):
    counted = ranges.hit_counts(b.queries(spark, sf), b.ranges(spark, sf))
    return reports.range_hits(counted, b.ranges(spark, sf), top=5)


@query("h9_bot_report", f"""
SELECT ip, min(at_us) AS first_seen_us, max(at_us) AS last_seen_us, count(*) AS query_count,
  {AS_OF_US} - max(at_us) < {b.FLOOD.ban_seconds * 1_000_000} AS banned FROM v_ban_steps WHERE at_us IS NOT NULL GROUP BY ip""")
def h9(spark, sf):
    bans = timed_bans(spark, sf)
    return reports.bot_report(
        traffic.detections(bans), bans, as_of_us=F.lit(AS_OF_US), ban_seconds=b.FLOOD.ban_seconds
    ).select("ip", "first_seen_us", "last_seen_us", "query_count", "banned")


@query("h10_block_statistics", "SELECT counter, blocked FROM v_counters")
def h10(spark, sf):
    return reports.block_statistics(block_counters(spark, sf))


@query("h11_status", """
SELECT (SELECT count(*) FROM v_clients) AS clients, (SELECT count(*) FROM v_clients WHERE NOT is_high_id) AS low_id_clients,
  (SELECT count(*) FROM v_clients WHERE natt_capable) AS natt_capable, (SELECT count(*) FROM v_files) AS files,
  (SELECT count(DISTINCT token) FROM v_postings) AS keywords, (SELECT count(DISTINCT ip) FROM v_floods) AS banned,
  (SELECT count(*) FROM v_rendezvous WHERE outcome = 'coordinated') AS coordinated""")
def h11(spark, sf):
    """Every address that ever floods is banned at least once."""
    return reports.status(
        b.clients(spark, sf), b.files(spark, sf), b.postings(spark, sf), timed_bans(spark, sf), rendezvous(spark, sf)
    )


@query("h12_catalog_shape", """
SELECT (SELECT count(*) FROM v_files) AS files, (SELECT CAST(sum(strlen(name)) AS BIGINT) FROM v_files) AS name_bytes,
  (SELECT CAST(sum(sources) AS BIGINT) FROM v_source_counts) AS sources_total, (SELECT max(sources) FROM v_source_counts) AS sources_max,
  (SELECT count(DISTINCT user_hash) FROM v_sources) AS users, (SELECT count(*) FROM v_sources) AS user_files,
  (SELECT count(DISTINCT token) FROM v_postings) AS keywords, (SELECT count(*) FROM v_postings) AS postings,
  (SELECT count(DISTINCT user_hash) FROM v_ledger) AS ledger_users""")
def h12(spark, sf):
    return reports.catalog_shape(b.files(spark, sf), b.sources(spark, sf), b.postings(spark, sf), b.ledger(spark, sf))


@query("h13_list_health", """
SELECT 'hashes' AS list, count(*) AS entries, count(*) > 0 AS ok FROM v_listed
UNION ALL SELECT 'ranges', count(*), count(*) > 0 FROM v_ranges
UNION ALL SELECT 'empty', count(*), count(*) > 0 FROM part WHERE p_size > 1000""")
def h13(spark, sf):
    return reports.list_health({
        "hashes": b.policy_hashes(spark, sf).select("file_hash").distinct(),
        "ranges": b.ranges(spark, sf),
        "empty": b.table(spark, sf, "part").filter(F.col("p_size") > 1000),
    })


@query("h14_latest_warnings", """
SELECT event_id, at_us, user_hash, (SELECT count(*) FROM v_events WHERE event_type = 'error') AS total_seen
FROM v_events WHERE event_type = 'error' ORDER BY at_us DESC, event_id DESC LIMIT 100""")
def h14(spark, sf):
    log = b.events(spark, sf).filter(F.col("event_type") == "error").select("event_id", "at_us", "user_hash")
    return reports.latest_warnings(log, seq="event_id")


@query("h15_peer_table", """
SELECT d.ip, d.port, d.ip IN (SELECT ip FROM v_verified) AS verified,
  d.ip IN (SELECT ip FROM v_advertised WHERE s_acctbal > 8000) AS has_key FROM v_directory d""")
def h15(spark, sf):
    keyed = advertised(spark, sf).filter(F.col("s_acctbal") > 8000)
    return reports.peer_table(directory(spark, sf).drop("added_us"), verified(spark, sf), keyed)


@query("h16_rendezvous_counters", "SELECT outcome, count(*) AS requests FROM v_rendezvous GROUP BY outcome")
def h16(spark, sf):
    return reports.rendezvous_counters(rendezvous(spark, sf))


@query("c5_approximate_keywords")
def c5_approximate(spark, sf):
    return index.approximate_keywords(b.postings(spark, sf))

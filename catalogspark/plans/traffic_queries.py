"""Floods, timed bans, repeat suppression, recent keys, peers, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.functions.ordered import greedy_spacing
from catalogspark.operators import peers, traffic
from catalogspark.plans import bindings as b
from catalogspark.plans.client_queries import AS_OF_US
from catalogspark.plans.registry import query, view

_W = b.FLOOD.window_seconds * 1_000_000
_RATE, _FLOOD = b.FLOOD.rate, b.FLOOD.flood_rate

view("v_gaps", """
SELECT ip, at_us, event_id, coalesce((at_us - lag(at_us) OVER (PARTITION BY ip ORDER BY at_us)) / 1000.0, 0.0) AS gap_ms FROM v_queries""")
view("v_measured", f"""
SELECT ip, at_us, event_id, samples, samples / greatest(span_ms / 1000.0, 0.001) * 60.0 AS qpm,
  CASE WHEN samples > 1 THEN sqrt(greatest(sq / (samples - 1) - pow(span_ms / (samples - 1), 2), 0.0)) END AS stddev_ms
FROM (SELECT i.ip, i.at_us, i.event_id, count(*) AS samples, (i.at_us - min(j.at_us)) / 1000.0 AS span_ms,
    sum(CAST(j.gap_ms AS DOUBLE) * j.gap_ms) - arg_min(CAST(j.gap_ms AS DOUBLE) * j.gap_ms, j.at_us) AS sq
  FROM v_queries i JOIN v_gaps j ON j.ip = i.ip AND j.at_us BETWEEN i.at_us - {_W} AND i.at_us
  GROUP BY i.ip, i.at_us, i.event_id)""")
_REASON = (
    f"CASE WHEN samples >= 3 AND qpm > {_FLOOD!r} THEN 'flood' "
    f"WHEN samples >= 3 AND qpm > {_RATE!r} AND stddev_ms < {b.FLOOD.stddev_ms!r} THEN 'uniform' END"
)
view("v_floods", f"SELECT * FROM (SELECT *, {_REASON} AS reason FROM v_measured) WHERE reason IS NOT NULL")


def _rates(spark, sf):
    return traffic.sliding_rates(b.queries(spark, sf), b.FLOOD)


@query("k1_sliding_rate", "SELECT event_id, samples, round(qpm, 9) AS qpm FROM v_measured")
def k1(spark, sf):
    return _rates(spark, sf).select("event_id", "samples", F.round("qpm", 9).alias("qpm"))


# Whole milliseconds, cut where no exact value of three samples can lie.
@query("k2_interval_stddev", """
SELECT event_id, CAST(floor(stddev_ms + 0.2503) AS BIGINT) AS stddev_ms FROM v_measured WHERE samples >= 3""")
def k2(spark, sf):
    return _rates(spark, sf).filter(F.col("samples") >= 3).select(
        "event_id", F.floor(F.col("stddev_ms") + 0.2503).alias("stddev_ms")
    )


@query("k3_flood_verdict", "SELECT event_id, ip, at_us, reason FROM v_floods")
def k3(spark, sf):
    return traffic.flood_events(b.queries(spark, sf), b.FLOOD).select("event_id", "ip", "at_us", "reason")


@query("k4_cooldown", """
WITH RECURSIVE v_kept AS (SELECT ip, min(at_us) AS at_us FROM v_floods GROUP BY ip
  UNION ALL SELECT k.ip, (SELECT min(f.at_us) FROM v_floods f WHERE f.ip = k.ip AND f.at_us >= k.at_us + 43200000000)
  FROM v_kept k WHERE k.at_us IS NOT NULL)
SELECT ip, at_us FROM v_kept WHERE at_us IS NOT NULL""")
def k4(spark, sf):
    found = traffic.flood_events(b.queries(spark, sf), b.FLOOD)
    return traffic.cooled_detections(
        found, seq="event_id", cooldown_seconds=b.FLOOD.cooldown_seconds
    ).select("ip", "at_us")


@b.kept
def timed_bans(spark, sf):
    return traffic.timed_bans(b.queries(spark, sf), b.FLOOD)


# One step of the recursion: the first event after the end of the previous ban at which
# the detector fires, with windows that reach back no further than that end.
view("v_ban_steps", f"""
SELECT ip, CAST(0 AS BIGINT) AS resumes, CAST(NULL AS BIGINT) AS at_us FROM v_queries GROUP BY ip
UNION ALL
SELECT s.ip, n.at_us + {b.FLOOD.ban_seconds * 1_000_000}, n.at_us FROM v_ban_steps s, LATERAL (
  SELECT min(at_us) AS at_us FROM (
    SELECT at_us, samples, samples / greatest(span_ms / 1000.0, 0.001) * 60.0 AS qpm,
      sqrt(greatest(sq / (samples - 1) - pow(span_ms / (samples - 1), 2), 0.0)) AS stddev_ms
    FROM (SELECT i.at_us, count(*) AS samples, (i.at_us - min(j.at_us)) / 1000.0 AS span_ms,
        sum(CAST(j.gap_ms AS DOUBLE) * j.gap_ms) - arg_min(CAST(j.gap_ms AS DOUBLE) * j.gap_ms, j.at_us) AS sq
      FROM v_gaps i JOIN v_gaps j ON j.ip = i.ip AND j.at_us BETWEEN greatest(i.at_us - {_W}, s.resumes) AND i.at_us
      WHERE i.ip = s.ip AND i.at_us >= s.resumes GROUP BY i.at_us, i.event_id HAVING count(*) >= 3))
  WHERE {_REASON} IS NOT NULL) n WHERE n.at_us IS NOT NULL""")


@query("k5_timed_bans", "SELECT ip, at_us FROM v_ban_steps WHERE at_us IS NOT NULL")
def k5(spark, sf):
    return timed_bans(spark, sf).select("ip", "at_us")


@query("k5_without_banned", f"""
SELECT ip, count(*) AS events FROM v_queries q WHERE NOT EXISTS (
  SELECT 1 FROM v_ban_steps s WHERE s.ip = q.ip AND q.at_us > s.at_us AND q.at_us - s.at_us < {b.FLOOD.ban_seconds * 1_000_000})
GROUP BY ip""")
def k5_without(spark, sf):
    return traffic.without_banned(
        b.queries(spark, sf), timed_bans(spark, sf), ban_seconds=b.FLOOD.ban_seconds
    ).groupBy("ip").agg(F.count("*").alias("events"))


@query("k6_ban_transitions", """
SELECT count(*) AS transitions, count(DISTINCT ip) AS ips FROM v_ban_steps WHERE at_us IS NOT NULL""")
def k6(spark, sf):
    return traffic.ban_transitions(timed_bans(spark, sf))


@query("k7_suppress_repeats", """
WITH RECURSIVE v_pass AS (SELECT user_id, event_type, min(at_us) AS at_us, 1::BIGINT AS pass_no FROM v_events GROUP BY ALL
  UNION ALL SELECT p.user_id, p.event_type, (SELECT min(e.at_us) FROM v_events e WHERE e.user_id = p.user_id
      AND e.event_type = p.event_type AND e.at_us >= p.at_us + 3 * 86400000000), p.pass_no + 1
  FROM v_pass p WHERE p.at_us IS NOT NULL)
SELECT user_id, event_type, pass_no, at_us, CASE WHEN before IS NULL THEN 0 ELSE (SELECT count(*) FROM v_events e
    WHERE e.user_id = p.user_id AND e.event_type = p.event_type AND e.at_us > before AND e.at_us < p.at_us) END AS suppressed
FROM (SELECT *, lag(at_us) OVER (PARTITION BY user_id, event_type ORDER BY pass_no) AS before FROM v_pass WHERE at_us IS NOT NULL) p""")
def k7(spark, sf):
    rows = b.events(spark, sf).select("user_id", "event_type", "at_us", "event_id")
    return traffic.suppress_repeats(
        rows, keys=["user_id", "event_type"], seq="event_id", window_seconds=3 * b.DAY
    ).select("user_id", "event_type", "pass_no", "at_us", "suppressed")


@query("k7_spaced_events", """
WITH RECURSIVE v_first AS (SELECT event_type, min(at_us) AS at_us FROM v_events GROUP BY ALL
  UNION ALL SELECT p.event_type, (SELECT min(e.at_us) FROM v_events e WHERE e.event_type = p.event_type
      AND e.at_us >= p.at_us + 3600000000) FROM v_first p WHERE p.at_us IS NOT NULL)
SELECT event_type, at_us FROM v_first WHERE at_us IS NOT NULL""")
def k7_spaced(spark, sf):
    """Few keys with long runs of events: an hour's spacing per event type."""
    rows = b.events(spark, sf).select("event_type", "at_us", "event_id")
    return greedy_spacing(
        rows, keys=["event_type"], ts_us="at_us", seq="event_id", gap_seconds=3600, chunk_gaps=24
    ).filter("kept").select("event_type", "at_us")


@query("k8_recent_keys", f"""
SELECT ip, max(at_us) AS last_seen_us FROM v_queries GROUP BY ip HAVING {AS_OF_US} - max(at_us) < 43200000000""")
def k8(spark, sf):
    return traffic.recent_keys(
        b.queries(spark, sf), key="ip", as_of_us=F.lit(AS_OF_US), ttl_seconds=12 * 3600
    )


_PEER_BASE = 1_006_632_960  # 60.0.0.0
view("v_advertised", f"""
SELECT CASE WHEN s_nationkey = 3 THEN 167772160 + s_suppkey ELSE {_PEER_BASE} + s_nationkey * 16000 END AS ip,
  CAST(CASE WHEN s_nationkey = 5 THEN 0 ELSE 4661 + s_suppkey % 3 END AS INTEGER) AS port, s_suppkey * 60000000 AS at_us, s_acctbal
FROM supplier""")
view("v_client_ips", f"SELECT DISTINCT {_PEER_BASE} + (user_id % 40) * 48000 AS ip FROM events WHERE event_type = 'view'")
view("v_directory", f"""
SELECT ip, port, min(at_us) AS added_us FROM v_advertised WHERE ip >= {_PEER_BASE} AND port <> 0
  AND ip NOT IN (SELECT ip FROM v_client_ips) GROUP BY ip, port ORDER BY added_us, ip, port LIMIT 50""")
view("v_verified", f"SELECT ip, port, at_us + 1800000000 AS at_us FROM v_advertised WHERE s_acctbal > 4000 AND ip >= {_PEER_BASE}")


def advertised(spark, sf):
    nation = F.col("s_nationkey")
    return b.table(spark, sf, "supplier").select(
        F.when(nation == 3, F.lit(b.BASE_IP) + F.col("s_suppkey"))
        .otherwise(F.lit(_PEER_BASE) + nation.cast("bigint") * 16000).alias("ip"),
        F.when(nation == 5, F.lit(0)).otherwise((F.lit(4661) + F.col("s_suppkey") % 3).cast("int")).alias("port"),
        (F.col("s_suppkey") * 60_000_000).alias("at_us"),
        "s_acctbal",
    )


def _client_ips(spark, sf):
    return b.table(spark, sf, "events").filter(F.col("event_type") == "view").select(
        (F.lit(_PEER_BASE) + (F.col("user_id") % 40) * 48000).alias("ip")
    ).distinct()


def directory(spark, sf):
    return peers.admit(advertised(spark, sf).drop("s_acctbal"), _client_ips(spark, sf), cap=50)


def verified(spark, sf):
    return advertised(spark, sf).filter((F.col("s_acctbal") > 4000) & (F.col("ip") >= _PEER_BASE)).select(
        "ip", "port", (F.col("at_us") + 1_800_000_000).alias("at_us")
    )


@query("k9_peer_directory", "SELECT ip, port, added_us FROM v_directory")
def k9(spark, sf):
    return directory(spark, sf)


_NOW = 5_000_000_000


@query("k9_peer_sweep", f"""
SELECT d.ip, d.port, d.added_us, v.ip IS NOT NULL AS verified FROM v_directory d
LEFT JOIN (SELECT DISTINCT ip FROM v_verified WHERE {_NOW} - at_us < 3600000000) v ON v.ip = d.ip
WHERE v.ip IS NOT NULL OR {_NOW} - d.added_us <= 4200000000""")
def k9_sweep(spark, sf):
    return peers.sweep(
        directory(spark, sf), verified(spark, sf), _client_ips(spark, sf), as_of_us=F.lit(_NOW), grace_seconds=4200
    )


@query("k9_peer_handout", f"""
SELECT ip, port, added_us FROM v_directory d WHERE EXISTS (SELECT 1 FROM v_verified v WHERE v.ip = d.ip AND v.port = d.port
  AND {_NOW} - v.at_us < 3600000000) ORDER BY added_us, ip, port LIMIT 10""")
def k9_handout(spark, sf):
    return peers.handout(directory(spark, sf), verified(spark, sf), as_of_us=F.lit(_NOW), cap=10)


@query("k10_snapshots", """
SELECT CAST(floor(at_us / 86400000000) * 86400 AS BIGINT) AS period_start, count(DISTINCT user_hash) AS users, count(*) AS events
FROM v_events GROUP BY 1""")
def k10(spark, sf):
    return traffic.snapshots(b.events(spark, sf), period_seconds=b.DAY)

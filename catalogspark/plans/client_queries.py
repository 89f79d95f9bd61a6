"""Clients, sessions and time-aware lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import clients
from catalogspark.plans import bindings as b
from catalogspark.plans.registry import query, view

AS_OF_US = 1_706_659_200_000_000  # 2024-01-31 00:00:00 UTC, the end of the event month


def latest_sessions(spark, sf):
    rows = b.logins(spark, sf).select(
        "user_hash", F.col("at_us").alias("login_ts"), F.col("event_id").alias("session_id"), "ip", "value"
    )
    return clients.latest_sessions(rows)


view("v_latest_sessions", """
SELECT user_hash, at_us AS login_ts, event_id AS session_id, ip, value FROM (SELECT *, row_number() OVER (
  PARTITION BY user_hash ORDER BY at_us DESC, event_id DESC) AS rn FROM v_logins) WHERE rn = 1""")


@query("j1_latest_sessions", "SELECT user_hash, login_ts, session_id, ip, value FROM v_latest_sessions")
def j1(spark, sf):
    return latest_sessions(spark, sf)


view("v_software_input", """
SELECT s_suppkey, CASE WHEN s_acctbal < 2000 THEN NULL WHEN s_acctbal < 6000 THEN 0 ELSE s_nationkey END AS compat_id,
  CASE s_nationkey % 8 WHEN 0 THEN 'MorphXT 12.7' WHEN 1 THEN 'eMule+ 1.2' WHEN 2 THEN 'The Xtreme 8' WHEN 3 THEN 'MLdonkey 3'
    WHEN 4 THEN 'Mephisto' WHEN 5 THEN 'eMulePlus 1' END AS mod,
  s_acctbal < 0 AS has_ext, CASE WHEN s_nationkey = 7 THEN 'my JED2K' WHEN s_nationkey = 15 THEN 'NoListSrvs' ELSE s_name END AS nick
FROM supplier""")
view("v_software", """
SELECT s_suppkey, CASE WHEN (s LIKE 'compat(%' OR s = 'eD2k-basic') AND (lower(nick) LIKE '%nolistsrvs%' OR lower(nick) LIKE '%mldonkey%')
    THEN 'mldonkey' WHEN (s LIKE 'compat(%' OR s = 'eD2k-basic') AND lower(nick) LIKE '%jed2k%' THEN 'jed2k' ELSE s END AS software
FROM (SELECT s_suppkey, nick, CASE WHEN starts_with(lower(mod), 'mldonkey') THEN 'mldonkey'
    WHEN compat_id = 0 AND mod IS NULL THEN 'eMule'
    WHEN compat_id = 0 AND (lower(mod) LIKE '%emule+%' OR lower(mod) LIKE '%emuleplus%') THEN 'eMulePlus'
    WHEN compat_id = 0 AND lower(mod) LIKE '%xtreme%' THEN 'eMule-Xtreme'
    WHEN compat_id = 0 AND lower(mod) LIKE '%mephisto%' THEN 'eMule-Mephisto'
    WHEN compat_id = 0 THEN concat('eMule-', split_part(mod, ' ', 1))
    WHEN compat_id IS NOT NULL THEN CASE compat_id WHEN 1 THEN 'cDonkey' WHEN 2 THEN 'xMule' WHEN 3 THEN 'aMule'
      WHEN 4 THEN 'Shareaza' WHEN 10 THEN 'mldonkey' WHEN 20 THEN 'lphant' ELSE concat('compat(', compat_id, ')') END
    WHEN mod IS NOT NULL AND lower(mod) LIKE '%emule+%' THEN 'eMulePlus'
    WHEN mod IS NOT NULL THEN concat('eMule-', split_part(mod, ' ', 1))
    WHEN has_ext THEN 'eMule-old' ELSE 'eD2k-basic' END AS s FROM v_software_input)""")


def software(spark, sf):
    acct, nation = F.col("s_acctbal"), F.col("s_nationkey")
    mods = ["MorphXT 12.7", "eMule+ 1.2", "The Xtreme 8", "MLdonkey 3", "Mephisto", "eMulePlus 1", None, None]
    rows = b.table(spark, sf, "supplier").select(
        "s_suppkey",
        F.when(acct < 2000, F.lit(None).cast("int")).when(acct < 6000, F.lit(0)).otherwise(nation).alias("compat_id"),
        F.get(F.array(*[F.lit(m) for m in mods]), nation % 8).alias("mod"),
        (acct < 0).alias("has_ext"),
        F.when(nation == 7, "my JED2K").when(nation == 15, "NoListSrvs").otherwise(F.col("s_name")).alias("nick"),
    )
    return clients.classify_software(rows)


@query("j2_client_software", "SELECT s_suppkey, software FROM v_software")
def j2(spark, sf):
    return software(spark, sf).select("s_suppkey", "software")


view("v_assigned", """
SELECT user_hash, event_id, at_us, CASE WHEN value > 20 THEN (ip >> 24 & 255) + (ip >> 16 & 255) * 256 + (ip >> 8 & 255) * 65536
  + (ip & 255) * 16777216 ELSE (sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) OVER (ORDER BY at_us, event_id) - 1) % 97 + 1 END AS assigned_id
FROM v_logins""")


def _assigned(spark, sf):
    rows = b.logins(spark, sf).select(
        "user_hash", "event_id", F.col("at_us").alias("login_us"), "ip", (F.col("value") > 20).alias("reachable")
    )
    return clients.assign_ids(rows, modulus=97)


@query("j3_assigned_ids", "SELECT event_id, CAST(assigned_id AS BIGINT) AS assigned_id FROM v_assigned")
def j3(spark, sf):
    return _assigned(spark, sf).select("event_id", "assigned_id")


@query("j4_client_counts", """
SELECT count(*) AS clients, count(*) FILTER (WHERE NOT is_high_id) AS low_id, count(*) FILTER (WHERE natt_capable) AS capable
FROM v_clients""")
def j4(spark, sf):
    return clients.client_counts(b.clients(spark, sf))


@query("j5_id_index", """
SELECT CAST(user_id % 97 AS BIGINT) AS assigned_id, user_hash, at_us FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id % 97 ORDER BY at_us DESC, user_hash DESC) AS rn FROM v_logins WHERE user_id % 97 <> 0) l
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM v_events e WHERE e.event_type = 'error' AND e.user_hash = l.user_hash
  AND e.at_us >= l.at_us)""")
def j5(spark, sf):
    """The id of the user's last login; an error event of the user gives the id back."""
    key = (F.col("user_id") % 97).alias("assigned_id")
    ended = b.events(spark, sf).filter(F.col("event_type") == "error")
    return clients.id_index(
        b.logins(spark, sf).select(key, "user_hash", "at_us"), ended.select(key, "user_hash", "at_us")
    )


def _channel(spark, sf, kind):
    return b.events(spark, sf).filter(F.col("event_type") == kind).select("user_hash", "at_us")


view("v_activity", "SELECT user_hash, at_us FROM v_events WHERE event_type IN ('view', 'click')")


@query("j6_sessions", """
SELECT user_hash, session_no, min(at_us) AS started_us, max(at_us) AS ended_us, count(*) AS events FROM (
  SELECT *, CAST(sum(opens) OVER (PARTITION BY user_hash ORDER BY at_us) AS BIGINT) AS session_no FROM (
    SELECT *, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY user_hash ORDER BY at_us) <= 86400000000 THEN 0 ELSE 1 END AS opens
    FROM v_activity)) GROUP BY ALL""")
def j6(spark, sf):
    activity = _channel(spark, sf, "view").unionByName(_channel(spark, sf, "click"))
    return clients.sessions(activity, idle_seconds=b.DAY)


@query("j6_alive", f"""
SELECT user_hash, max(at_us) AS last_activity_us, {AS_OF_US} - max(at_us) <= 86400000000 AS alive FROM v_activity GROUP BY user_hash""")
def j6_alive(spark, sf):
    last = clients.last_activity(_channel(spark, sf, "view"), _channel(spark, sf, "click"))
    return clients.alive(last, as_of_us=F.lit(AS_OF_US), idle_seconds=b.DAY)


@query("j7_fresh_value", """
SELECT p.user_hash, p.event_id AS probe_id, p.at_us, p.event_id AS announced,
  CASE WHEN o.port <> 0 AND p.at_us - o.at_us < 43200000000 THEN o.port ELSE p.event_id END AS effective
FROM (SELECT * FROM v_events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_hash, at_us, event_id % 5 AS port FROM v_events WHERE event_type = 'click') o
  ON p.user_hash = o.user_hash AND p.at_us >= o.at_us""")
def j7(spark, sf):
    rows = b.events(spark, sf)
    probes = rows.filter(F.col("event_type") == "purchase").select(
        "user_hash", "at_us", F.col("event_id").alias("probe_id"), F.col("event_id").alias("announced")
    )
    seen = rows.filter(F.col("event_type") == "click").select(
        "user_hash", "at_us", (F.col("event_id") % 5).alias("value")
    )
    return clients.fresh_value(probes, seen, tolerance_seconds=12 * 3600)


@query("j8_keep_alive", "SELECT user_hash, max(at_us) AS last_activity_us FROM v_activity GROUP BY user_hash")
def j8(spark, sf):
    return clients.last_activity(_channel(spark, sf, "view"), _channel(spark, sf, "click"))


view("v_contacts", """
SELECT event_id AS request_id, user_id + 1 AS requester_id, value > 20 AS requester_high,
  CASE WHEN event_id % 2 = 0 THEN event_id % 200 ELSE 167772160 + (event_id % 150) * 7919 END AS target_id
FROM v_events WHERE event_type = 'error'""")
view("v_rendezvous", """
SELECT request_id, requester_id, target_id, outcome, CASE WHEN outcome = 'coordinated' THEN least(requester_id, target_id) END AS initiator_id
FROM (SELECT r.*, CASE WHEN requester_id = target_id THEN 'bad_request' WHEN c.assigned_id IS NULL THEN 'not_connected'
    WHEN NOT alive THEN 'target_dead' WHEN is_high_id THEN 'target_high_id' WHEN udp_port = 0 THEN 'no_udp_port'
    ELSE 'coordinated' END AS outcome FROM v_contacts r LEFT JOIN v_clients c ON c.assigned_id = r.target_id)""")


def _contacts(spark, sf):
    even = F.col("event_id") % 2 == 0
    target = F.when(even, F.col("event_id") % 200).otherwise(F.lit(b.BASE_IP) + (F.col("event_id") % 150) * 7919)
    return b.events(spark, sf).filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("request_id"), (F.col("user_id") + 1).alias("requester_id"),
        (F.col("value") > 20).alias("requester_high"), target.alias("target_id"),
    )


def rendezvous(spark, sf):
    return clients.rendezvous(_contacts(spark, sf).drop("requester_high"), b.clients(spark, sf))


@query("j9_rendezvous", "SELECT request_id, requester_id, target_id, outcome, initiator_id FROM v_rendezvous")
def j9(spark, sf):
    return rendezvous(spark, sf)


@query("j10_callbacks", """
SELECT request_id, target_id, CASE WHEN NOT requester_high THEN 'ignored' WHEN c.assigned_id IS NULL THEN 'failed'
  ELSE 'forwarded' END AS outcome FROM v_contacts r LEFT JOIN v_clients c ON c.assigned_id = r.target_id""")
def j10(spark, sf):
    return clients.callbacks(_contacts(spark, sf).drop("requester_id"), b.clients(spark, sf))

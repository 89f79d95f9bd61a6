"""IP ranges, countries, endpoint ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.functions import net
from catalogspark.operators import ranges
from catalogspark.plans import bindings as b
from catalogspark.plans.catalog_queries import country_tables
from catalogspark.plans.registry import query, view

view("v_any_ips", """
SELECT event_id, event_type, CAST(concat('0x', substr(md5(concat('i', event_id)), 1, 8)) AS BIGINT) AS ip FROM events""")


def _any_ips(spark, sf):
    """Addresses spread over the whole space."""
    digest = F.substring(F.md5(F.concat(F.lit("i"), F.col("event_id").cast("string"))), 1, 8)
    return b.table(spark, sf, "events").select(
        "event_id", "event_type", F.conv(digest, 16, 10).cast("bigint").alias("ip")
    )


@query("i1_ip_from_text", """
SELECT s_suppkey, CASE WHEN s_acctbal < 0 OR s_acctbal >= 7000 THEN NULL
  ELSE 10 * 16777216 + s_nationkey * 65536 + 7 * 256 + (s_suppkey % 256) END AS ip FROM supplier""")
def i1(spark, sf):
    acct = F.col("s_acctbal")
    last = (F.col("s_suppkey") % 256).cast("string")
    text = (
        F.when(acct < 0, F.concat(F.lit("10.300.7."), last))
        .when(acct >= 8000, F.concat(F.lit("10.7."), last))
        .when(acct >= 7000, F.concat(F.lit("10.1.x."), last))
        .otherwise(F.concat_ws(".", F.lit("010"), F.col("s_nationkey").cast("string"), F.lit("007"), last))
    )
    return b.table(spark, sf, "supplier").select("s_suppkey", net.ip_from_text(text).alias("ip"))


view("v_merged", """
SELECT min(range_start) AS range_start, max(range_end) AS range_end FROM (
  SELECT *, sum(opens) OVER (ORDER BY range_start, range_end) AS grp FROM (
    SELECT *, CASE WHEN range_start <= max(range_end) OVER (ORDER BY range_start, range_end
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS opens FROM v_ranges)) GROUP BY grp""")
view("v_wide_ranges", """
SELECT 167772160 + c_custkey * 900 AS range_start, 167772160 + c_custkey * 900
  + CASE c_mktsegment WHEN 'BUILDING' THEN 5000 WHEN 'MACHINERY' THEN 899 ELSE 100 END AS range_end FROM customer""")


@query("i2_merge_ranges", "SELECT range_start, range_end FROM v_merged")
def i2(spark, sf):
    return ranges.merge_ranges(b.ranges(spark, sf))


@query("i2_merge_overlapping", """
SELECT min(range_start) AS range_start, max(range_end) AS range_end FROM (
  SELECT *, sum(opens) OVER (ORDER BY range_start, range_end) AS grp FROM (
    SELECT *, CASE WHEN range_start <= max(range_end) OVER (ORDER BY range_start, range_end
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS opens FROM v_wide_ranges)) GROUP BY grp""")
def i2_overlapping(spark, sf):
    start = F.lit(b.BASE_IP) + F.col("c_custkey") * 900
    width = F.when(F.col("c_mktsegment") == "BUILDING", 5000).when(F.col("c_mktsegment") == "MACHINERY", 899).otherwise(100)
    rows = b.table(spark, sf, "customer").select(start.alias("range_start"), (start + width).alias("range_end"))
    return ranges.merge_ranges(rows)


@query("i3_membership", """
SELECT DISTINCT q.ip, m.range_start, m.range_end FROM v_queries q JOIN v_merged m ON q.ip BETWEEN m.range_start AND m.range_end""")
def i3(spark, sf):
    return ranges.blocked_ips(b.queries(spark, sf), b.ranges(spark, sf))


@query("i4_hit_counts", """
SELECT range_start, range_end, count(*) AS hits FROM (
  SELECT q.ip, r.* FROM v_queries q ASOF JOIN v_ranges r ON q.ip >= r.range_start) WHERE ip <= range_end GROUP BY ALL""")
def i4(spark, sf):
    return ranges.hit_counts(b.queries(spark, sf), b.ranges(spark, sf))


@query("i5_country", """
SELECT country, event_type, count(*) AS events FROM (
  SELECT CASE WHEN e.ip <= c.range_end THEN c.code ELSE '??' END AS country, e.event_type
  FROM v_events e ASOF LEFT JOIN v_country_lines c ON e.ip >= c.range_start) GROUP BY ALL""")
def i5(spark, sf):
    rows, _ = country_tables(spark, sf)
    return ranges.with_country(b.events(spark, sf), rows).groupBy("country", "event_type").agg(
        F.count("*").alias("events")
    )


@query("i6_routable", """
SELECT event_id, NOT priv AND NOT (ip BETWEEN 2851995648 AND 2852061183) AS routable,
  NOT priv AND NOT (ip BETWEEN 3758096384 AND 4026531839) AS public_peer
FROM (SELECT *, ip = 0 OR ip = 4294967295 OR ip // 16777216 IN (10, 127) OR ip BETWEEN 2886729728 AND 2887778303
  OR ip BETWEEN 3232235520 AND 3232301055 AS priv FROM v_any_ips)""")
def i6(spark, sf):
    ip = F.col("ip")
    return _any_ips(spark, sf).select(
        "event_id", net.is_routable(ip).alias("routable"), net.is_public_peer(ip).alias("public_peer")
    )


@query("i7_endpoint_id", """
SELECT event_id, (ip >> 24 & 255) + (ip >> 16 & 255) * 256 + (ip >> 8 & 255) * 65536 + (ip & 255) * 16777216 AS endpoint_id,
  concat(ip >> 24 & 255, '.', ip >> 16 & 255, '.', ip >> 8 & 255, '.', ip & 255) AS dotted FROM v_any_ips""")
def i7(spark, sf):
    ip = F.col("ip")
    return _any_ips(spark, sf).select(
        "event_id", net.endpoint_id(ip).alias("endpoint_id"), net.ip_to_text(ip).alias("dotted")
    )


@query("i8_connection_gate", """
SELECT event_type, count(*) FILTER (WHERE hit) AS blocked, count(*) FILTER (WHERE NOT hit) AS accepted FROM (
  SELECT event_type, EXISTS (SELECT 1 FROM v_merged m WHERE e.ip BETWEEN m.range_start AND m.range_end) AS hit FROM v_events e)
GROUP BY event_type""")
def i8(spark, sf):
    gated = ranges.connection_gate(b.events(spark, sf), b.ranges(spark, sf))
    return gated.groupBy("event_type").agg(
        F.count_if("blocked").alias("blocked"), F.count_if(~F.col("blocked")).alias("accepted")
    )

"""Sources and catalog build."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.functions import net
from catalogspark.operators import catalog
from catalogspark.plans import bindings as b
from catalogspark.plans.registry import query, view
from catalogspark.sources import lists, offers as offer_source

AS_OF_2001 = "timestamp '2001-01-01 00:00:00'"


@query("a1_offer_source", """
SELECT session_id, count(*) AS offers, CAST(sum(size) AS BIGINT) AS bytes,
  count(*) FILTER (WHERE complete) AS complete FROM v_offers GROUP BY session_id""")
def a1(spark, sf):
    return offer_source.accept_offers(b.offers(spark, sf)).groupBy("session_id").agg(
        F.count("*").alias("offers"), F.sum("size").alias("bytes"), F.count_if("complete").alias("complete")
    )


def _padded(ip):
    return F.concat_ws(
        ".", *[F.lpad(F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string"), 3, "0") for s in (24, 16, 8, 0)]
    )


@query("a2_ip_range_reader", """
SELECT CASE WHEN s_acctbal >= 0 THEN 167772160 + s_suppkey * 16000 END AS range_start,
  CASE WHEN s_acctbal >= 0 THEN 167772160 + s_suppkey * 16000 + 7000 + (s_suppkey % 2) * 8999 END AS range_end,
  CASE WHEN s_acctbal >= 0 THEN 100 END AS level,
  CASE WHEN s_acctbal >= 0 THEN concat(s_name, ' , x') ELSE '' END AS description, s_acctbal >= 0 AS ok
FROM supplier""")
def a2(spark, sf):
    rows = b.ranges(spark, sf).join(
        b.table(spark, sf, "supplier").select(F.col("s_name").alias("description"), "s_acctbal"), "description"
    )
    good = F.concat(
        _padded(F.col("range_start")), F.lit(" - "), _padded(F.col("range_end")),
        F.lit(" , 100 , "), F.col("description"), F.lit(" , x "),
    )
    lines = rows.select(F.when(F.col("s_acctbal") >= 0, good).otherwise(F.concat(F.lit("300.1.1.1 - "), "description")).alias("value"))
    return lists.parse_ip_ranges(lines).drop("value")


view("v_country_lines", """
SELECT 167772160 + s_suppkey * 16000 AS range_start, 167772160 + s_suppkey * 16000 + 9000 AS range_end,
  concat(chr(CAST(65 + n_nationkey % 26 AS INTEGER)), 'Q') AS code, concat(n_name, ', ', s_name) AS name, s_suppkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")


def country_tables(spark, sf):
    """Country ranges read back from text lines."""
    start = F.lit(b.BASE_IP) + F.col("s_suppkey") * 16000
    lines = b.table(spark, sf, "supplier").join(
        b.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        F.concat_ws(
            ",", start.cast("string"), (start + 9000).cast("string"),
            F.concat(F.char(F.lit(97) + F.col("n_nationkey") % 26), F.lit("qz")),
            F.concat("n_name", F.lit(", "), "s_name"),
        ).alias("value"),
        F.col("s_suppkey").alias("line_no"),
    )
    return lists.parse_country_ranges(lines)


@query("a3_country_reader", """
SELECT range_start, range_end, code, first_value(name) OVER (PARTITION BY code ORDER BY s_suppkey) AS name
FROM v_country_lines""")
def a3(spark, sf):
    rows, names = country_tables(spark, sf)
    return rows.join(names, "code")


@query("a4_hash_list_reader", """
SELECT p_partkey AS line_no, CASE WHEN p_size <= 40 THEN md5(concat('f', p_partkey)) END AS file_hash,
  p_size <= 40 AS ok FROM part WHERE p_size <= 45""")
def a4(spark, sf):
    digest = F.upper(b.file_id("p_partkey"))
    lines = b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("line_no"),
        F.when(F.col("p_size") <= 40, F.concat(F.lit("  "), digest, F.lit(" ; "), "p_name"))
        .when(F.col("p_size") <= 45, F.concat(F.lit("zz"), digest))
        .otherwise(F.concat(F.lit("# "), digest)).alias("value"),
    )
    return lists.parse_hash_list(lines).drop("value")


@query("a5_term_list_reader", """
SELECT lower(p_name) AS term, count(*) AS lines FROM part WHERE p_size < 40 GROUP BY 1""")
def a5(spark, sf):
    lines = b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("line_no"),
        F.when(F.col("p_size") < 40, F.concat(F.lit("\t"), F.upper("p_name"), F.lit("  ")))
        .when(F.col("p_size") < 45, F.lit("   ")).otherwise(F.concat(F.lit("#"), "p_name")).alias("value"),
    ).withColumn("value", F.regexp_replace("value", r"\A\s+|\s+\z", ""))
    return lists.parse_terms(lines).groupBy("term").agg(F.count("*").alias("lines"))


@query("a6_rule_reader", """
SELECT lower(r_name) AS section, lower(n_name) AS entry FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT lower(p_type), lower(p_brand) FROM part
UNION ALL SELECT 'limits', 'window=24'""")
def a6(spark, sf):
    regions = b.table(spark, sf, "region")
    heads = regions.select((F.col("r_regionkey") * 1000).alias("line_no"), F.concat(F.lit("[ "), "r_name", F.lit(" ]")).alias("value"))
    items = b.table(spark, sf, "nation").select(
        (F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).alias("line_no"),
        F.concat("n_name", F.lit(" ; note")).alias("value"),
    )
    limits = regions.agg((F.max("r_regionkey") + 1).alias("r")).select(
        F.explode(F.array(
            F.struct((F.col("r") * 1000).alias("line_no"), F.lit("[limits]").alias("value")),
            F.struct((F.col("r") * 1000 + 1).alias("line_no"), F.lit("window = 24").alias("value")),
        )).alias("l")
    ).select("l.*")
    known = {f"region_{i}" for i in range(5)} | {"africa", "america", "asia", "europe", "middle east"}
    entries, _ = lists.parse_rules(
        heads.unionByName(items).unionByName(limits), known_sections=known, known_limits={"window"}
    )
    defaults = b.table(spark, sf, "part").select(
        F.lower("p_type").alias("section"), F.lower("p_brand").alias("entry")
    ).distinct()
    return lists.with_defaults(entries, defaults)


@query("b1_files", "SELECT file_hash, name, size, last_us FROM v_files")
def b1(spark, sf):
    return b.files(spark, sf).select("file_hash", "name", "size", F.unix_micros("last_seen").alias("last_us"))


@query("b1_merge_files", "SELECT file_hash, name, size, last_us FROM v_files")
def b1_merge(spark, sf):
    """Catalog built in two parts, before and after a date, then merged."""
    rows = b.offers(spark, sf)
    cut = F.lit("1998-06-01").cast("timestamp")
    merged = catalog.merge_files(
        catalog.files(rows.filter(F.col("ts") < cut)), catalog.files(rows.filter(F.col("ts") >= cut))
    )
    return merged.select("file_hash", "name", "size", F.unix_micros("last_seen").alias("last_us"))


_SOURCES_SQL = "SELECT file_hash, user_hash, ip, port, complete, first_us, last_us FROM v_sources"


def _with_us(rows):
    return rows.select(
        "file_hash", "user_hash", "ip", "port", "complete",
        F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"),
    )


@query("b2_sources", _SOURCES_SQL)
def b2(spark, sf):
    return _with_us(b.sources(spark, sf))


@query("b2_merge_sources", _SOURCES_SQL)
def b2_merge(spark, sf):
    rows = b.offers(spark, sf)
    cut = F.lit("1998-06-01").cast("timestamp")
    return _with_us(
        catalog.merge_sources(
            catalog.sources(rows.filter(F.col("ts") < cut)), catalog.sources(rows.filter(F.col("ts") >= cut))
        )
    )


@query("b3_complete_marker", """
SELECT user_hash, count(*) FILTER (WHERE complete) AS complete, count(*) FILTER (WHERE NOT complete) AS partial
FROM v_offers GROUP BY user_hash""")
def b3(spark, sf):
    return b.offers(spark, sf).groupBy("user_hash").agg(
        F.count_if("complete").alias("complete"), F.count_if(~F.col("complete")).alias("partial")
    )


@query("b4_size_halves", """
SELECT p_partkey, big // 4294967296 AS size_high, big % 4294967296 AS size_low, big AS joined
FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * 1234567891 + p_partkey AS big FROM part)""")
def b4(spark, sf):
    big = F.col("p_size").cast("bigint") * 1234567891 + F.col("p_partkey")
    halves = b.table(spark, sf, "part").select(
        "p_partkey", net.size_high(big).alias("size_high"), net.size_low(big).alias("size_low")
    )
    return halves.withColumn("joined", net.join_size(F.col("size_high"), F.col("size_low")))


@query("b5_files_per_user", """
SELECT user_hash, count(DISTINCT file_hash) AS files FROM v_offers GROUP BY user_hash""")
def b5(spark, sf):
    return catalog.files_per_user(b.sources(spark, sf))


@query("b6_over_limit_users", """
SELECT user_hash, count(DISTINCT file_hash) AS files FROM v_offers GROUP BY user_hash
HAVING count(DISTINCT file_hash) > 500""")
def b6(spark, sf):
    return catalog.over_limit_users(b.sources(spark, sf), 500)


view("v_departed", "SELECT user_hash FROM v_clients WHERE NOT is_high_id")
view("v_kept_sources", "SELECT * FROM v_sources WHERE user_hash NOT IN (SELECT user_hash FROM v_departed)")


@query("b7_remove_users", """
SELECT f.file_hash, f.name, count(*) AS sources FROM v_files f JOIN v_kept_sources s ON f.file_hash = s.file_hash
GROUP BY f.file_hash, f.name""")
def b7(spark, sf):
    files, sources = catalog.remove_users(b.files(spark, sf), b.sources(spark, sf), b.departed(spark, sf))
    return files.select("file_hash", "name").join(catalog.source_counts(sources), "file_hash").select(
        "file_hash", "name", "sources"
    )


def _low_sources(spark, sf):
    """Sources of unreachable users only, so most files are orphans."""
    return b.sources(spark, sf).join(b.departed(spark, sf), "user_hash", "left_semi")


@query("b8_orphans", """
SELECT file_hash, name FROM v_files WHERE file_hash NOT IN
  (SELECT file_hash FROM v_sources WHERE user_hash IN (SELECT user_hash FROM v_departed))""")
def b8(spark, sf):
    return catalog.orphans(b.files(spark, sf), _low_sources(spark, sf)).select("file_hash", "name")


@query("b8_evict_orphans", """
SELECT file_hash, name FROM v_files WHERE last_us > epoch_us(TIMESTAMP '2001-11-01') - 365 * 86400000000
  OR file_hash IN (SELECT file_hash FROM v_sources WHERE user_hash IN (SELECT user_hash FROM v_departed))""")
def b8_evict(spark, sf):
    as_of = F.lit("2001-11-01").cast("timestamp")
    return catalog.evict_orphans(
        b.files(spark, sf), _low_sources(spark, sf), as_of=as_of, grace_seconds=365 * b.DAY
    ).select("file_hash", "name")


@query("b9_purge_reverse_index", """
SELECT user_hash, count(*) AS files FROM v_sources WHERE file_hash NOT IN (SELECT file_hash FROM v_withheld)
GROUP BY user_hash""")
def b9(spark, sf):
    kept = catalog.purge_reverse_index(
        b.sources(spark, sf).select("user_hash", "file_hash"), b.withheld(spark, sf)
    )
    return kept.groupBy("user_hash").agg(F.count("*").alias("files"))


@query("b10_source_counts", """
SELECT file_hash, sources, sources AS complete_sources, complete_true FROM v_source_counts""")
def b10(spark, sf):
    return catalog.source_counts(b.sources(spark, sf))


@query("b11_expire", """
SELECT file_hash, user_hash, last_us FROM v_sources
WHERE epoch_us(TIMESTAMP '2001-01-01') - last_us < 365 * 86400000000""")
def b11(spark, sf):
    as_of = F.lit("2001-01-01").cast("timestamp")
    return catalog.expire(b.sources(spark, sf), "last_ts", 365 * b.DAY, as_of).select(
        "file_hash", "user_hash", F.unix_micros("last_ts").alias("last_us")
    )


@query("b12_capped_admission", """
SELECT file_hash, count(*) AS offers FROM v_offers WHERE file_hash IN (
  SELECT file_hash FROM v_offers GROUP BY file_hash ORDER BY min(at_us), file_hash LIMIT 500) GROUP BY file_hash""")
def b12(spark, sf):
    return catalog.capped_admission(b.offers(spark, sf), "file_hash", "ts", 500).groupBy("file_hash").agg(
        F.count("*").alias("offers")
    )


@query("b13_effective_departures", """
SELECT DISTINCT user_hash FROM (
  SELECT user_hash, event_id AS session, row_number() OVER (PARTITION BY user_hash ORDER BY at_us DESC, event_id DESC) AS rn
  FROM v_logins) WHERE rn = 1 AND session IN (SELECT event_id FROM v_logins WHERE value > 20)""")
def b13(spark, sf):
    sessions = b.logins(spark, sf).select(
        "user_hash", F.col("event_id").alias("session_id"), F.col("at_us").alias("login_ts"), "value"
    )
    ended = sessions.filter(F.col("value") > 20).select("user_hash", "session_id")
    return catalog.effective_departures(sessions, ended)

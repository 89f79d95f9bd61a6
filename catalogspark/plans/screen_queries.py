"""Content-policy screening and publisher enforcement."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalogspark.functions import text
from catalogspark.operators import enforce, screen, terms
from catalogspark.operators.screen import Quantity, Words
from catalogspark.plans import bindings as b
from catalogspark.plans.registry import query, view


def _names(spark, sf):
    return b.offers(spark, sf).select("name").distinct()


@query("e1_hash_lists", """
SELECT md5(concat('f', p_partkey)) AS file_hash,
  CASE listed WHEN 0 THEN 'allow' WHEN 1 THEN 'ban' WHEN 2 THEN 'poison' END AS decided_by
FROM part LEFT JOIN v_listed l ON l.file_hash = md5(concat('f', p_partkey))""")
def e1(spark, sf):
    rows = b.table(spark, sf, "part").select(b.file_id("p_partkey").alias("file_hash"))
    at = F.col("__listed")
    name = F.when(at == 0, "allow").when(at == 1, "ban").when(at == 2, "poison")
    return rows.join(screen.hash_verdicts(b.policy_hashes(spark, sf)), "file_hash", "left").select(
        "file_hash", name.alias("decided_by")
    )


@query("e2_first_term", "SELECT name, l1, l4 FROM v_name_parts")
def e2(spark, sf):
    lowered = F.lower("name")
    return _names(spark, sf).select(
        "name",
        text.first_matching_term(lowered, list(b.TERMS)).alias("l1"),
        text.first_matching_term(lowered, list(b.EXTRA_TERMS)).alias("l4"),
    )


@query("e2_document_terms", """
SELECT doc_id, CASE WHEN regexp_matches(n, '(^|[^a-z])license') THEN 'license'
  WHEN regexp_matches(n, '(^|[^a-z])que($|[^a-z0-9_])') THEN 'que$'
  WHEN regexp_matches(n, '(^|[^a-z])und($|[^a-z])') THEN 'und' WHEN regexp_matches(n, '(^|[^a-z])of($|[^a-z])') THEN 'of' END AS term
FROM (SELECT doc_id, lower(text) AS n FROM documents)""")
def e2_documents(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", text.first_matching_term(F.lower("text"), ["license", "que$", "und", "of"]).alias("term")
    )


view("v_vendor_terms", """
SELECT min(p_partkey) AS ord, term FROM (
  SELECT p_partkey, concat(split_part(p_name, ' ', 2), CASE p_partkey % 3 WHEN 0 THEN '$' ELSE '' END) AS term FROM part WHERE p_partkey % 7 = 0
  UNION ALL SELECT p_partkey, concat(p_size, 'kg') FROM part WHERE p_partkey % 11 = 0
  UNION ALL SELECT p_partkey, concat(p_name, '.') FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT p_partkey, lower(p_brand) FROM part) WHERE p_partkey > 40 GROUP BY term""")


@query("e2_term_table", r"""
SELECT name, arg_min(term, (ord, term)) AS term FROM (SELECT DISTINCT name, lower(name) AS n FROM v_offers) JOIN v_vendor_terms
  ON contains(n, rtrim(term, '$')) AND regexp_matches(n, concat('(^|[^a-z])', regexp_escape(rtrim(term, '$')),
    CASE WHEN term LIKE '%$' THEN '($|[^a-z0-9_])' WHEN length(term) < 6 AND NOT term LIKE '%.' THEN '($|[^a-z])' ELSE '' END))
GROUP BY name""")
def e2_table(spark, sf):
    """A list of one entry and more per part, as a table."""
    part, key = b.table(spark, sf, "part").filter("p_partkey > 40"), F.col("p_partkey")
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    listed = F.array_compact(F.array(
        F.when(key % 7 == 0, F.concat(word, F.when(key % 3 == 0, "$").otherwise(""))),
        F.when(key % 11 == 0, F.concat(F.col("p_size").cast("string"), F.lit("kg"))),
        F.when(key % 5 == 0, F.concat("p_name", F.lit("."))), F.lower("p_brand")))
    names = _names(spark, sf).withColumn("n", F.lower("name"))
    found = terms.first_terms(names, part.select(key.alias("ord"), F.explode(listed).alias("term")), text_col="n")
    return names.join(found, F.col("n") == F.col("text")).select("name", "term")


@query("e3_repair", r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN md5(text) END AS repaired FROM documents""")
def e3(spark, sf):
    """Whole texts doubly encoded, then repaired back."""
    mangled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return b.table(spark, sf, "documents").select(
        "doc_id", F.md5(text.repair_double_encoding(mangled)).alias("repaired")
    )


@query("e4_screen_files", "SELECT file_hash, name, layer, reason FROM v_screened_files")
def e4(spark, sf):
    return b.screened_files(spark, sf).select("file_hash", "name", "layer", "reason")


@query("e4_screen_offers", """
SELECT file_hash, layer, reason, count(*) AS offers FROM v_screened_offers GROUP BY ALL""")
def e4_offers(spark, sf):
    return b.screened_offers(spark, sf).groupBy("file_hash", "layer", "reason").agg(F.count("*").alias("offers"))


@query("e5_rule", "SELECT name, l2 AS reason FROM v_name_rules")
def e5(spark, sf):
    return _names(spark, sf).withColumn("reason", screen.rule_reason(F.lower("name"), b.RULE))


@query("e6_boundaries", """
SELECT name, contains(n, 'in') AS plain, regexp_matches(n, '(^|[^a-z0-9_])(red|b)') AS prefixed,
  regexp_matches(n, '(^|[^a-z0-9_])(box|mp3|old)($|[^a-z0-9_])') AS bounded
FROM (SELECT DISTINCT name, lower(name) AS n FROM v_offers)""")
def e6(spark, sf):
    lowered = F.lower("name")
    return _names(spark, sf).select(
        "name",
        lowered.rlike(Words(substring=("in",)).pattern()).alias("plain"),
        lowered.rlike(Words(prefix=("red", "b")).pattern()).alias("prefixed"),
        lowered.rlike(Words(bounded=("box", "mp3", "old")).pattern()).alias("bounded"),
    )


@query("e7_quantity", r"""
SELECT name, regexp_extract(n, '(^|[^a-z0-9_])((?:40|[1-3][0-9]|0?[5-9]) *kg)($|[^a-z0-9_])', 2) AS found,
  regexp_matches(n, '(^|[^a-z0-9_])(?:40|[1-3][0-9]|0?[5-9]) *kg($|[^a-z0-9_])')
    AND NOT regexp_matches(n, '(^|[^a-z])gear[^a-z]{1,8}[0-9]{1,2} *kg') AND NOT contains(n, 'kg.pdf')
    AND NOT contains(n, 'small') AS spelled
FROM (SELECT DISTINCT name, lower(name) AS n FROM v_offers)""")
def e7(spark, sf):
    lowered = F.lower("name")
    compact = text.any_of(screen.quantity_patterns(Quantity(5, 40, compact=("kg",))))
    spelled = text.any_of(screen.quantity_patterns(
        Quantity(5, 40, spelled=("kg",), veto_after=(".pdf",), veto_before=("gear",), veto_near=("small",))
    ))
    return _names(spark, sf).select(
        "name", F.regexp_extract(lowered, compact, 0).alias("found"), lowered.rlike(spelled).alias("spelled")
    )


@query("e8_guard_window", r"""
SELECT name, qty AND NOT (contains(win, 'box') OR contains(win, 'red')) AS unguarded FROM (
  SELECT name, qty, substr(n, greatest(pos - 15, 0) + 1, pos + 15 - greatest(pos - 15, 0)) AS win FROM (
    SELECT name, n, regexp_matches(n, '(^|[^a-z0-9_])[0-9]{1,2} *kg($|[^a-z0-9_])') AS qty,
      length(regexp_extract(n, '^(.*[^a-z0-9_])[0-9]{1,2} *kg', 1)) AS pos
    FROM (SELECT DISTINCT name, lower(name) AS n FROM v_offers)))""")
def e8(spark, sf):
    pattern = text.any_of(screen.quantity_patterns(
        Quantity(0, 99, compact=("kg",)), compact_only=True, guards=("box", "red"), window=15
    ))
    return _names(spark, sf).select("name", F.lower("name").rlike(pattern).alias("unguarded"))


@query("e9_paired_marker", "SELECT p_partkey, p_size > 25 AS paired FROM part")
def e9(spark, sf):
    size = F.col("p_size").cast("string")
    label = F.concat("p_name", F.lit(" b"), size, F.when(F.col("p_size") > 25, F.concat(F.lit(" g"), size)).otherwise(""))
    return b.table(spark, sf, "part").select(
        "p_partkey", screen.paired_marker(F.lower(label), "bg").alias("paired")
    )


@query("e10_level_caps", """
SELECT p_partkey, (p_type = 'MEDIUM' AND p_size % 10 BETWEEN 1 AND 6)
  OR (p_type = 'LARGE' AND p_size % 10 BETWEEN 1 AND 3) AS capped FROM part""")
def e10(spark, sf):
    label = F.concat("p_type", F.lit(" "), (F.col("p_size") % 10).cast("string"), F.lit(" x"))
    pattern = screen.level_pattern((("medium", 6), ("large", 3)))
    return b.table(spark, sf, "part").select("p_partkey", F.lower(label).rlike(pattern).alias("capped"))


@query("e11_layer_attributes", """
SELECT layer, layer <> 'L5' AS counts_against_publisher, CASE layer WHEN 'L1' THEN 'policy_L1_terms'
  WHEN 'L2' THEN 'policy_L2_rule' WHEN 'L3' THEN 'policy_L3_hash' WHEN 'L4' THEN 'policy_L4_extra'
  ELSE 'poison_L5_hash' END AS stat_key, count(*) AS offers
FROM v_screened_offers WHERE layer IS NOT NULL GROUP BY layer""")
def e11(spark, sf):
    per_layer = b.screened_offers(spark, sf).filter(F.col("layer").isNotNull()).groupBy("layer").agg(
        F.count("*").alias("offers")
    )
    return per_layer.join(screen.layer_attributes(spark), "layer").drop("total_key")


b.SQL_TERM["plate"] = "(^|[^a-z])plate($|[^a-z])"
NEXT_TERMS = ("widget", "plate", "rod$")
view("v_next_verdict", f"""
SELECT f.file_hash, f.name, f.layer AS old_layer, f.reason AS old_reason,
  CASE WHEN listed IN (1, 2) THEN 'L' || (CASE listed WHEN 1 THEN 3 ELSE 5 END) WHEN l1n IS NOT NULL THEN 'L1'
    WHEN l2 IS NOT NULL THEN 'L2' WHEN l4 IS NOT NULL THEN 'L4' END AS layer,
  CASE WHEN listed = 1 THEN 'hash' WHEN listed = 2 THEN 'poison' ELSE coalesce(l1n, l2, l4) END AS reason
FROM v_screened_files f JOIN (SELECT *, {b.sql_first_term('n', NEXT_TERMS)} AS l1n FROM v_name_rules) r ON f.name = r.name
LEFT JOIN (SELECT md5(concat('f', p_partkey)) AS file_hash, CASE p_brand WHEN 'Brand#13' THEN 1 ELSE 2 END AS listed
  FROM part WHERE p_brand IN ('Brand#13', 'Brand#24')) l ON l.file_hash = f.file_hash""")


@query("e12_rescreen", """
SELECT file_hash, name, old_layer, old_reason, layer, reason FROM v_next_verdict
WHERE layer IS DISTINCT FROM old_layer OR reason IS DISTINCT FROM old_reason""")
def e12(spark, sf):
    """Whitelist emptied, one term exchanged."""
    current = b.policy(spark, sf)
    after = replace(current, hashes=current.hashes.filter(F.col("list") != "allow"), terms=NEXT_TERMS)
    return screen.rescreen(b.screened_files(spark, sf).drop("size", "last_seen"), after)


@query("e12_list_changes", """
SELECT file_hash, name, old_layer, old_reason, layer, reason FROM v_next_verdict
WHERE layer IS DISTINCT FROM old_layer OR reason IS DISTINCT FROM old_reason""")
def e12_changes(spark, sf):
    """The same change, applied to the files that it concerns."""
    current = b.policy(spark, sf)
    after = replace(current, hashes=current.hashes.filter(F.col("list") != "allow"), terms=NEXT_TERMS)
    return screen.rescreen_changes(b.screened_files(spark, sf).drop("size", "last_seen"), current, after, b.name_runs(spark, sf))


@query("e4_term_tables", "SELECT file_hash, name, layer, reason FROM v_screened_files")
def e4_tables(spark, sf):
    """Screening with both term lists as tables."""
    lists = b.policy(spark, sf)
    as_tables = replace(lists, terms=terms.term_table(spark, lists.terms), extra_terms=terms.term_table(spark, lists.extra_terms))
    return screen.screen(b.files(spark, sf), as_tables).select("file_hash", "name", "layer", "reason")


@query("e13_audit_names", """
SELECT sha256(name) AS name_sha256, layer, count(*) AS offers FROM v_screened_offers
WHERE layer IS NOT NULL GROUP BY ALL""")
def e13(spark, sf):
    blocked = b.screened_offers(spark, sf).filter(F.col("layer").isNotNull())
    return blocked.groupBy("name", "layer").agg(F.count("*").alias("offers")).select(
        screen.audit_name(F.col("name")).alias("name_sha256"), "layer", "offers"
    )


# -- publisher enforcement ----------------------------------------------------

@query("f1_ledger", "SELECT user_hash, epoch, file_hash, name, layer, reason, size, caught_us FROM v_ledger")
def f1(spark, sf):
    return b.ledger(spark, sf).drop("caught_at", "ip")


@query("f1_ledger_epochs", """
SELECT user_hash, epoch, count(*) AS files, min(caught_us) AS first_us FROM (
  SELECT user_hash, file_hash, epoch, min(at_us) AS caught_us FROM (
    SELECT *, CAST(sum(opens) OVER (PARTITION BY user_hash ORDER BY at_us) AS BIGINT) AS epoch FROM (
      SELECT *, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY user_hash ORDER BY at_us) <= 5 * 86400000000
        THEN 0 ELSE 1 END AS opens FROM v_catches)) GROUP BY ALL) GROUP BY ALL""")
def f1_epochs(spark, sf):
    """A five-day retention, short enough to open several epochs."""
    rows = enforce.ledger(b.catches(spark, sf), retention_seconds=5 * b.DAY)
    return rows.groupBy("user_hash", "epoch").agg(
        F.count("*").alias("files"), F.min("caught_us").alias("first_us")
    )


@query("f2_window_counts", "SELECT user_hash, epoch, file_hash, caught_us, in_window FROM v_window_counts")
def f2_counts(spark, sf):
    return enforce.window_counts(b.ledger(spark, sf), window_seconds=b.COUNT_WINDOW)


@query("f2_publisher_bans", "SELECT user_hash, banned_us, last_banned_us, peak FROM v_publisher_bans")
def f2(spark, sf):
    return b.publisher_bans(spark, sf)


view("v_ban_marks", f"""
SELECT c.user_hash, c.at_us AS caught_us FROM (SELECT DISTINCT user_hash, epoch, at_us FROM v_epochs) c
JOIN v_ledger l ON l.user_hash = c.user_hash AND l.epoch = c.epoch
  AND l.caught_us BETWEEN c.at_us - {b.COUNT_WINDOW * 1_000_000} AND c.at_us
GROUP BY ALL HAVING count(*) > {b.THRESHOLD}""")
view("v_order_logins", """
SELECT md5(concat('u', o_custkey)) AS user_hash, epoch_us(o_orderdate) AS login_us, o_orderkey AS event_id FROM orders""")


@query("f2_ban_marks", "SELECT user_hash, caught_us FROM v_ban_marks")
def f2_marks(spark, sf):
    return b.ban_marks(spark, sf)


@query("f3_refused_logins", """
SELECT l.user_hash, l.event_id, l.login_us, m.caught_us AS since_us,
  coalesce(l.login_us - m.caught_us < 2 * 86400000000, false) AS refused
FROM v_order_logins l ASOF LEFT JOIN v_ban_marks m ON l.user_hash = m.user_hash AND l.login_us >= m.caught_us""")
def f3(spark, sf):
    logins = b.table(spark, sf, "orders").select(
        b.user_id("o_custkey").alias("user_hash"), b.us("o_orderdate").alias("login_us"),
        F.col("o_orderkey").alias("event_id"),
    )
    return enforce.refused_logins(logins, b.ban_marks(spark, sf), ttl_seconds=2 * b.DAY)


view("v_flagged", """
SELECT o.batch_id, o.seq, o.file_hash, o.name, o.layer IN ('L1', 'L2', 'L3', 'L4') AND m.user_hash IS NOT NULL AS bans
FROM v_screened_offers o LEFT JOIN v_ban_marks m ON m.user_hash = o.user_hash AND m.caught_us = o.at_us""")


@query("f4_truncated_batches", """
SELECT batch_id, count(*) AS processed, max(seq) AS last_seq FROM v_flagged f WHERE seq <= coalesce(
  (SELECT min(seq) FROM v_flagged g WHERE coalesce(g.bans, false) AND g.batch_id = f.batch_id), seq) GROUP BY batch_id""")
def f4(spark, sf):
    """Only catches ban, so the other records go by batch and number alone."""
    banning = b.catches(spark, sf).select("user_hash", "caught_us", "batch_id", "seq").join(
        b.ban_marks(spark, sf), ["user_hash", "caught_us"], "left_semi")
    records = b.offers(spark, sf).select("batch_id", "seq")
    return enforce.truncate_batches(records, banning).groupBy("batch_id").agg(
        F.count("*").alias("processed"), F.max("seq").alias("last_seq")
    )


view("v_first_blocks", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_hash
  ORDER BY ts, seq, user_hash, file_hash, name, complete) AS rn FROM v_screened_offers WHERE layer IS NOT NULL)
WHERE rn = 1""")
view("v_counters", """
SELECT counter, count(*) AS blocked FROM (
  SELECT CASE layer WHEN 'L1' THEN 'policy_L1_terms' WHEN 'L2' THEN 'policy_L2_rule' WHEN 'L3' THEN 'policy_L3_hash'
    WHEN 'L4' THEN 'policy_L4_extra' ELSE 'poison_L5_hash' END AS counter FROM v_first_blocks
  UNION ALL SELECT CASE layer WHEN 'L5' THEN 'poison' ELSE 'policy' END FROM v_first_blocks) GROUP BY counter""")


def block_counters(spark, sf):
    return enforce.block_counters(b.screened_offers(spark, sf).filter(F.col("layer").isNotNull()))


@query("f5_block_counters", "SELECT counter, blocked FROM v_counters")
def f5(spark, sf):
    return block_counters(spark, sf)


@query("f6_blocked_ips", """
SELECT (SELECT count(DISTINCT ip) FROM v_catches) AS exact_ips,
  (SELECT count(DISTINCT ip) FROM v_first_blocks WHERE layer <> 'L5') AS first_bringer_ips""")
def f6(spark, sf):
    blocked = b.screened_offers(spark, sf).filter(F.col("layer").isNotNull())
    exact = enforce.blocked_ips(blocked).withColumnRenamed("ips", "exact_ips")
    first = enforce.blocked_ips(blocked, first_bringer_only=True).withColumnRenamed("ips", "first_bringer_ips")
    return exact.crossJoin(first)


@query("f7_session_strikes", """
SELECT session_id, user_hash, at_us AS disconnect_us, seq, CAST(rn AS INTEGER) AS strike FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq, user_hash, file_hash, name, complete) AS rn
  FROM v_catches) WHERE rn = 4""")
def f7(spark, sf):
    return enforce.session_strikes(b.screened_offers(spark, sf), threshold=3)


@query("f8_batch_totals", """
SELECT batch_id, count(*) FILTER (WHERE layer IS NULL) AS accepted, count(*) FILTER (WHERE layer IS NOT NULL) AS blocked
FROM v_screened_offers GROUP BY batch_id""")
def f8(spark, sf):
    return enforce.batch_totals(b.screened_offers(spark, sf))

"""Alias and decoy analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.functions.filetype import size_contradicts_extension
from catalogspark.operators import aliases, reports
from catalogspark.plans import bindings as b
from catalogspark.plans.registry import query, view

_ORDER = "ts, seq, user_hash, file_hash, name, complete"


def _words(name: str, measure: str) -> str:
    return f"list_filter(string_split_regex(lower({name}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: {measure}(w) >= 4)"


view("v_ordered_offers", f"""
SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY {_ORDER}) AS rn,
  first_value(name) OVER (PARTITION BY file_hash ORDER BY {_ORDER}) AS stored FROM v_offers""")
view("v_divergent", f"""
SELECT *, NOT list_has_any({_words('name', 'length')}, {_words('stored', 'length')}) AS apart
FROM v_ordered_offers WHERE size >= 2097152 AND name <> stored""")
view("v_admitted", "SELECT file_hash, min(rn) AS admitted FROM v_divergent WHERE apart GROUP BY file_hash")
view("v_alias_names", """
SELECT d.file_hash, d.stored, d.name, min(d.rn) AS first, count(*) AS n, max(d.at_us) AS last_us, any_value(d.size) AS size
FROM v_divergent d JOIN v_admitted a ON a.file_hash = d.file_hash AND d.rn >= a.admitted GROUP BY ALL""")
view("v_aliases", """
SELECT file_hash, list_prepend(any_value(stored), list(name ORDER BY first) FILTER (WHERE pos <= 11)) AS names,
  CAST(sum(n) AS BIGINT) AS seen, any_value(size) AS size, max(last_us) AS last_us
FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY first) AS pos FROM v_alias_names)
GROUP BY file_hash""")
view("v_alias_scores", f"""
SELECT *, len(list_filter(names[2:], lambda m: NOT list_has_any({_words('m', 'strlen')}, {_words('names[1]', 'strlen')}))) AS unrelated
FROM v_aliases""")


@b.kept
def alias_records(spark, sf):
    return aliases.alias_records(b.offers_by_file(spark, sf))


@query("g1_admissions", f"""
SELECT a.file_hash, o.stored, o.at_us AS admitted_us, o.name AS admitting_name FROM v_admitted a
JOIN v_ordered_offers o ON o.file_hash = a.file_hash AND o.rn = a.admitted""")
def g1(spark, sf):
    return aliases.admissions(b.offers_by_file(spark, sf)).select(
        "file_hash", "stored", F.unix_micros("admitted.ts").alias("admitted_us"),
        F.col("admitted.name").alias("admitting_name"),
    )


@query("g2_alias_records", """
SELECT file_hash, array_to_string(names, '|') AS names, seen, size, last_us FROM v_aliases""")
def g2(spark, sf):
    return alias_records(spark, sf).select(
        "file_hash", F.array_join("names", "|").alias("names"), "seen", "size",
        F.unix_micros("last_seen").alias("last_us"),
    )


@query("g3_unrelated_names", "SELECT file_hash, unrelated FROM v_alias_scores")
def g3(spark, sf):
    return alias_records(spark, sf).select("file_hash", aliases.unrelated_names(F.col("names")).cast("bigint").alias("unrelated"))


@query("g4_size_contradiction", """
SELECT DISTINCT name, size, regexp_matches(lower(name), '[.](pdf|jpg)$') AND size > 52428800 AS size_flag FROM v_offers""")
def g4(spark, sf):
    return b.offers(spark, sf).select("name", "size").distinct().withColumn(
        "size_flag", size_contradicts_extension(F.col("name"), F.col("size"))
    )


@query("g5_alias_ranking", """
SELECT file_hash, unrelated, size, CAST(len(names) AS INTEGER) AS name_count, array_to_string(names[1:6], '|') AS names,
  len(list_filter(names, lambda m: regexp_matches(lower(m), '[.](pdf|jpg)$'))) > 0 AND size > 52428800 AS size_flag
FROM v_alias_scores ORDER BY unrelated DESC, size DESC, file_hash LIMIT 60""")
def g5(spark, sf):
    return aliases.rank_aliases(alias_records(spark, sf)).select(
        "file_hash", F.col("unrelated").cast("bigint").alias("unrelated"), "size", "name_count",
        F.array_join("names", "|").alias("names"), "size_flag",
    )


@query("g6_size_campaigns", """
SELECT s.size, s.files, CAST(member AS INTEGER) AS member, file_hash, name_count, unrelated FROM (
  SELECT size, count(*) AS files FROM v_aliases GROUP BY size HAVING count(*) >= 2 ORDER BY files DESC, size DESC LIMIT 20) s
JOIN (SELECT size, file_hash, CAST(len(names) AS INTEGER) AS name_count, unrelated,
  row_number() OVER (PARTITION BY size ORDER BY file_hash) AS member FROM v_alias_scores) m
  ON m.size = s.size AND member <= 12""")
def g6(spark, sf):
    return aliases.size_campaigns(alias_records(spark, sf)).withColumn("unrelated", F.col("unrelated").cast("bigint"))


view("v_by_file_names", f"""
SELECT l.file_hash, l.layer, l.reason, l.size, l.name, l.caught_us, n.name_count, n.unrelated, n.names FROM (
  SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY caught_us, user_hash, layer, reason, size, name) AS rn
  FROM v_ledger) l
JOIN (SELECT file_hash, count(*) AS name_count, count(*) FILTER (WHERE name <> lead AND NOT list_has_any(
      {_words('name', 'strlen')}, {_words('lead', 'strlen')})) AS unrelated,
    list(name ORDER BY pos) FILTER (WHERE pos <= 12) AS names
  FROM (SELECT *, first_value(name) OVER (PARTITION BY file_hash ORDER BY pos) AS lead FROM (
    SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY caught_us, user_hash, layer, reason, size, name) AS pos
    FROM (SELECT file_hash, name, caught_us, user_hash, layer, reason, size, row_number() OVER (
        PARTITION BY file_hash, name ORDER BY caught_us, user_hash, layer, reason, size) AS k FROM v_ledger) WHERE k = 1))
  GROUP BY file_hash) n ON n.file_hash = l.file_hash
WHERE rn = 1""")


@b.kept
def caught_names(spark, sf):
    return reports.caught_names(b.ledger(spark, sf))


@b.kept
def blocks_by_file(spark, sf):
    return reports.blocks_by_file(b.ledger(spark, sf), per_name=caught_names(spark, sf))


@query("g7_decoys", """
SELECT file_hash, unrelated, name_count, size, name, regexp_matches(lower(name), '[.](pdf|jpg)$') AND size > 52428800 AS size_flag
FROM v_by_file_names WHERE layer = 'L3' AND (unrelated > 0 OR (regexp_matches(lower(name), '[.](pdf|jpg)$') AND size > 52428800))
ORDER BY unrelated DESC, name_count DESC, file_hash LIMIT 60""")
def g7(spark, sf):
    return aliases.decoys(blocks_by_file(spark, sf)).select(
        "file_hash", "unrelated", "name_count", "size", "name", "size_flag"
    )

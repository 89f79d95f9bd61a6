"""Mixing sources to target weights by Pareto order sampling.

A source's target is a multiple ``f`` of its size. Every document of the source is
taken ``floor(f)`` times for certain; the rest of the target is filled by a Pareto
order sample: documents are ranked by the odds of a uniform number over the odds of
their inclusion, ``(u / (1 - u)) / (p / (1 - p))`` with ``p = f - floor(f)``, and the
lowest ranks are taken until the source's remaining words are reached. The last
document taken is the one that brings the sum nearest, so a source misses its target by
at most half the size of one document.

No source is ever ordered in one task. Ranks are found by two rounds of
histograms over the score (4096 buckets, then 4096 inside the bucket where the
remainder runs out); only the documents of one fine bucket are numbered by a window.

Defined results: a null text has size 0; sources order by code point, null last; rows
of size 0 are taken when their rank lies before the remainder; repeated rows count each
for itself; an empty table gives an empty result; documents of equal score are ranked by
size, then id. Extra columns travel in ``row`` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, before, text_of, unit_random, written

BUCKETS = 4096


def word_count(column: str) -> Column:
    """Number of blank-separated words, 0 for null."""
    return F.regexp_count(text_of(column), F.lit(f"[^{BLANKS}]+")).cast("bigint")


def source_targets(sized: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """One row per source: its size, target, whole copies, probability and remainder.

    ``sized`` has ``source`` and ``size``. Targets are the water level at which weight
    times level, cut at ``most`` times the source's size, adds up to ``share`` of all.
    Runs over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    fill = Window.orderBy("ratio", "place")
    everything = Window.partitionBy()
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = (
        per.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("filled", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("filled")) / F.col("open"))
        .withColumn("fits", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level")))
        .withColumn("level", F.min("fits").over(everything)["level"])
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))))
    )
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        per.withColumn("whole", F.floor(times))
        .withColumn("p", times - F.col("whole"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "p", "rest")
    )


def _crossing(scored: DataFrame, bucket: str, keys: list[str], start: Column) -> DataFrame:
    """Per source the bucket in which the remainder runs out, and the words ahead of it."""
    sums = scored.groupBy("source", *keys, bucket).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first(start).alias("start"))
    ahead = sums.withColumn("ahead", F.col("start") + before("words", "source", order=[bucket]))
    at = ahead.filter((F.col("ahead") <= F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("words")))
    return at.select(F.col("source").alias("at_source"), F.col(bucket).alias(f"at_{bucket}"), F.col("ahead").alias(f"ahead_{bucket}"))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17,
) -> DataFrame:
    """Each row of ``docs`` as struct ``row`` with ``size``, ``source_size``, ``target`` and ``copies``."""
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"),
        word_count(text_col).alias("size"), unit_random(F.lit(seed), F.col(id_col)).alias("u"), F.col(id_col).alias("id"),
    )
    slim = written(packed.select("source", "size", "u", "id"))
    per = written(source_targets(slim, weights, share, most))

    # The score grows with the odds; x = score / (1 + score) maps it onto [0, 1).
    odds = F.col("u") / (1 - F.col("u"))
    score = odds / (F.col("p") / (1 - F.col("p")))

    def scored(df: DataFrame) -> DataFrame:
        x = F.when(F.col("p") > 0, score / (1 + score)).otherwise(F.lit(0.0)) * BUCKETS
        df = df.join(per.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        df = df.withColumn("x", x).withColumn("coarse", F.floor("x").cast("int"))
        return df.withColumn("fine", F.floor((F.col("x") - F.col("coarse")) * BUCKETS).cast("int"))

    same = F.col("source").eqNullSafe(F.col("at_source"))
    ranked = scored(slim).filter("p > 0")
    coarse = written(_crossing(ranked, "coarse", [], F.lit(0)))
    inside = ranked.join(coarse, same & (F.col("coarse") == F.col("at_coarse"))).drop("at_source")
    fine = _crossing(inside, "fine", ["coarse"], F.col("ahead_coarse")).withColumnRenamed("at_source", "fine_source")
    cuts = written(coarse.join(fine, F.col("at_source").eqNullSafe(F.col("fine_source")), "left").drop("fine_source"))

    decided = scored(packed).join(cuts, same, "left").drop("at_source")
    place = F.struct("coarse", "fine")
    cut = F.struct(F.col("at_coarse").alias("coarse"), F.col("at_fine").alias("fine"))
    # Without a crossing the remainder covers all ranks (or is zero, with p = 0).
    decided = decided.withColumn("side", F.when(F.col("p") <= 0, 1).when(F.col("at_coarse").isNull() | (place < cut), -1).when(place > cut, 1).otherwise(0))
    clear = decided.filter("side <> 0").withColumn("extra", (F.col("side") < 0).cast("int"))
    at = Window.partitionBy("source").orderBy("x", "size", "id").rowsBetween(Window.unboundedPreceding, -1)
    close = decided.filter("side = 0").withColumn("ahead", F.col("ahead_fine") + F.coalesce(F.sum("size").over(at), F.lit(0)))
    close = close.withColumn("extra", (F.col("ahead") + F.col("size") / 2 <= F.col("rest")).cast("int")).drop("ahead")
    return clear.unionByName(close).select(
        "row", "size", "source_size", "target", (F.col("whole") + F.col("extra")).cast("int").alias("copies")
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: the rows of the documents, each as often as it is taken."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op4_mix_sources(spark, sf_dir):
    from .common import table

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("copies") * F.col("size")).cast("bigint")
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM sized GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM per),
r AS (SELECT *, cap / weight AS ratio FROM w),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
    1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM r),
l AS (SELECT (wanted - filled) / open AS level FROM f WHERE (wanted - filled) / open <= ratio ORDER BY ratio, place LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT level FROM l), cap)) AS target FROM r),
g AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS times FROM t),
d AS (SELECT s.doc_id, s.size, s.u, g.*, floor(times) AS whole, times - floor(times) AS p
  FROM sized s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
o AS (SELECT *, target - whole * source_size AS rest, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) ELSE 0 END AS score FROM d),
a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY score, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN p > 0 AND ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM a
"""

"""Keyword index: postings, deltas, statistics and conjunctive lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalogspark.functions.text import SEPARATORS, is_token
from catalogspark.operators.catalog import write_bucketed


def postings(named: DataFrame, *, id_col: str = "file_hash", text_col: str = "name") -> DataFrame:
    """One row per (token, id). Distinctness is settled inside the row, without a shuffle."""
    words = F.array_distinct(F.split(F.lower(text_col), SEPARATORS))
    return (
        named.select(F.explode(words).alias("token"), id_col)
        .filter(is_token(F.col("token")))
    )


def write_postings(rows: DataFrame, table: str, *, buckets: int) -> None:
    """Save postings bucketed and sorted by token, so lookups and joins on token do not shuffle."""
    write_bucketed(rows, table, key="token", buckets=buckets, sort=["token", "file_hash"])


def apply_delta(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Postings after adds and removes; per (token, file) the last change decides.

    ``changes``: token, file_hash, op ('add' | 'remove'), ts, seq.
    """
    last = changes.groupBy("token", "file_hash").agg(
        F.max_by("op", F.struct("ts", "seq", "op")).alias("op")
    )
    untouched = base.join(last, ["token", "file_hash"], "left_anti")
    return untouched.unionByName(last.filter(F.col("op") == "add").select("token", "file_hash"))


def token_counts(rows: DataFrame) -> DataFrame:
    """Length of every posting list."""
    return rows.groupBy("token").agg(F.count("*").alias("postings"))


def index_stats(rows: DataFrame) -> DataFrame:
    """Keyword count, posting total, longest and shortest list."""
    return token_counts(rows).agg(
        F.count("*").alias("keywords"),
        F.sum("postings").alias("postings"),
        F.max("postings").alias("longest"),
        F.min("postings").alias("shortest"),
    )


def approximate_keywords(rows: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Sketch-based keyword count for dashboards."""
    return rows.agg(F.approx_count_distinct("token", rsd).alias("keywords"))


def having_all(rows: DataFrame, tokens: list[str], *, id_col: str = "file_hash") -> DataFrame:
    """Ids whose postings include every token."""
    wanted = sorted(set(tokens))
    return (
        rows.filter(F.col("token").isin(*wanted))
        .groupBy(id_col)
        .agg(F.count("*").alias("__hits"))
        .filter(F.col("__hits") == len(wanted))
        .select(id_col)
    )


#: Registers of a sketch, as a power of two. The estimate's relative standard deviation is about 1 / sqrt(2 ** LOG_REGISTERS).
LOG_REGISTERS = 12


def keyword_sketches(rows: DataFrame, *keys: str) -> DataFrame:
    """A sketch of the distinct tokens of every batch: (keys, sketch). Kept, sketches of batches unite to that of all."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg("token", F.lit(LOG_REGISTERS)).alias("sketch"))


def united_keywords(sketches: DataFrame, *keys: str) -> DataFrame:
    """Estimated keyword counts (keys, keywords) of united sketches; the tokens are not read again."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("keywords"))

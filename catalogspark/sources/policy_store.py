"""Versioned policy lists in shared storage.

A version is written in full before its number is appended to the log, so a
reader sees complete versions only. A failed read keeps the policy in use.
"""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogspark.operators.screen import Policy, Rule
from catalogspark.operators.terms import term_table

#: Up to so many entries a list goes into the plan as one pattern, a longer one stays a table; the verdicts are the same.
INLINE_TERMS = 1_000

log = logging.getLogger(__name__)


def publish(
    spark: SparkSession, root: str, version: int, *, hashes: DataFrame,
    terms: tuple[str, ...] | DataFrame = (), extra_terms: tuple[str, ...] | DataFrame = (),
) -> None:
    """Write one version. ``hashes``: file_hash, list. Term lists of any length are tables (ord, term)."""
    hashes.select("file_hash", "list").write.mode("overwrite").parquet(f"{root}/hashes/version={version}")
    tables = {"terms": terms, "extra": extra_terms}
    tables = {name: t if isinstance(t, DataFrame) else term_table(spark, t) for name, t in tables.items()}
    rows = [t.select(F.lit(name).alias("list"), F.col("ord").cast("bigint").alias("ord"), "term") for name, t in tables.items()]
    rows[0].unionByName(rows[1]).write.mode("overwrite").parquet(f"{root}/terms/version={version}")
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{root}/log")


def current_version(spark: SparkSession, root: str) -> int:
    return spark.read.parquet(f"{root}/log").agg(F.max("version")).head()[0]


def load(spark: SparkSession, root: str, *, rule: Rule | None = None, public: bool = False) -> Policy:
    """The newest complete version."""
    version = current_version(spark, root)
    rows = spark.read.parquet(f"{root}/terms/version={version}")

    def entries(name: str) -> tuple[str, ...] | DataFrame:
        listed = rows.filter(F.col("list") == name).select("ord", "term")
        first = listed.orderBy("ord").head(INLINE_TERMS + 1)
        return tuple(r["term"] for r in first) if len(first) <= INLINE_TERMS else listed

    return Policy(
        hashes=spark.read.parquet(f"{root}/hashes/version={version}"),
        terms=entries("terms"),
        extra_terms=entries("extra"),
        rule=rule,
        public=public,
    )


def refresh(spark: SparkSession, root: str, current: Policy) -> Policy:
    """The newest version, or the one in use when it cannot be read. Emptied lists apply as written."""
    try:
        return load(spark, root, rule=current.rule, public=current.public)
    except (PySparkException, ValueError) as error:
        log.warning("policy kept: %s", error)
        return current

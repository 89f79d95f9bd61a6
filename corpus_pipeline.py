"""From raw documents to training shards: each stage works on all that the one before kept.

    quality -> near_dedup -> decontaminate -> mix -> shard

``run`` writes every stage's result to the shared checkpoint folder and goes on from
there. A stage begins by deleting the intermediate tables of the stages before it, whose
results are at rest by then. Every stage but the last returns the columns of ``documents``; the mix returns a
document as often as it is taken, so its rows repeat from there on. The last stage adds
``shard`` and ``slot``, in place of columns of these names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm import decontam, mixing, neardup, quality, shards
from catalogspark.llm.common import listening, release, table, written

SHARDS = 16


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return neardup.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(mixing.mix(docs))


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return shards.shard(docs, SHARDS).select(*own, "shard", "slot")


def _stages() -> list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]]:
    """The stages in order. Each deletes the intermediate tables of those before it, whose results are at rest."""
    stages = [
        ("quality", quality_stage),
        ("near_dedup", near_dedup_stage),
        ("decontaminate", decontaminate_stage),
        ("mix", mix_stage),
        ("shard", shard_stage),
    ]
    tables: list[list[str]] = [[] for _ in stages]

    def tidy(k: int, stage: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for earlier in tables[:k]:
                release(spark, earlier, docs)
                earlier.clear()
            tables[k] = []  # what an earlier run wrote may still be read
            with listening(tables[k]):
                return stage(spark, docs, sf_dir)

        return run_stage

    return [(name, tidy(k, stage)) for k, (name, stage) in enumerate(stages)]


STAGES = _stages()

#: The classifier has no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs

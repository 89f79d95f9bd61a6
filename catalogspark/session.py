"""Session settings the operators are planned for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the sizing: partitions start small and are coalesced,
# skewed join partitions are split, and a side is broadcast only when its
# measured size is below the threshold. No operator forces a broadcast.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    # Split a hot key's side of a join even when the step after it must then shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# What results or skew handling depend on; sizes are left to the cluster.
RUNTIME = [
    "spark.sql.session.timeZone",
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.adaptive.forceOptimizeSkewedJoin",
]


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the recommended settings to a session builder."""
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def apply(spark: SparkSession) -> None:
    """Set the settings that results or skew handling depend on, on a running session."""
    for key in RUNTIME:
        if spark.conf.isModifiable(key):
            spark.conf.set(key, RECOMMENDED[key])


# Shuffles of catalog queries start with at least so many pieces, which runtime re-planning coalesces by measured size:
# sorts of a piece then stay in memory however few partitions a session names. With more than 200
# (spark.shuffle.sort.bypassMergeThreshold) map tasks would sort their whole input before they write it.
PIECES = 200


def apply_pieces(spark: SparkSession) -> None:
    """Start shuffles with enough pieces, unless the session names their number itself."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(max(PIECES, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; make one only where none is named."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

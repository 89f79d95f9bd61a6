"""Report sinks and the incremental review export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from catalogspark.functions.ordered import MICROS
from catalogspark.operators.reports import blocks_by_file, review_csv_rows, window_rows

FIRST_EXPORT_HOURS = 24


def write_review_csv(by_file: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Semicolon-separated review lines with a header; nothing is quoted."""
    (
        review_csv_rows(by_file).write.mode(mode)
        .options(sep=";", header=True, quote="", escapeQuotes=False, emptyValue="")
        .csv(path)
    )


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.options(sep=";", header=True, quote="", emptyValue="")
        .schema("hash string, layer string, reason string, size bigint, sizeflag string, "
                "names bigint, unrelated bigint, name string")
        .csv(path)
        .fillna("", ["sizeflag"])
    )


def write_report(report: DataFrame, path: str, fmt: str = "json", *, mode: str = "overwrite") -> None:
    report.write.mode(mode).format(fmt).save(path)


def last_watermark(spark: SparkSession, path: str) -> int | None:
    """Latest committed export instant in epoch microseconds."""
    try:
        return spark.read.schema("watermark_us bigint").parquet(path).agg(F.max("watermark_us")).head()[0]
    except AnalysisException:
        return None


def export_review(
    first_catches: DataFrame, *, out: str, watermark: str, now_us: int,
    hours: int | None = None, everything: bool = False, peek: bool = False,
) -> DataFrame:
    """Write the review of the window; the watermark moves only after the write succeeded.

    Without options the window starts at the previous export, or 24 hours back at
    the first one. Returns the exported rows.
    """
    spark = first_catches.sparkSession
    since = None
    if not everything:
        previous = last_watermark(spark, watermark)
        if hours is not None:
            since = now_us - hours * 3600 * MICROS
        elif previous is not None:
            since = previous
        else:
            since = now_us - FIRST_EXPORT_HOURS * 3600 * MICROS
    rows = window_rows(first_catches, ts_us="caught_us", since_us=None if since is None else F.lit(since))
    by_file = blocks_by_file(rows)
    write_review_csv(by_file, out)
    if not peek:
        spark.range(1).select(F.lit(now_us).cast("bigint").alias("watermark_us")).write.mode("append").parquet(watermark)
    return by_file

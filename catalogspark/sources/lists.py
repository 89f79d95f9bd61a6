"""Readers of operator lists: IP ranges, countries, hashes, terms, sectioned rules.

Every parser takes lines as a DataFrame with ``value`` and, where the order of
lines matters, ``line_no``; bad lines go to a reject column instead of vanishing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from catalogspark.functions.net import ip_from_text

_U32_MAX = 4_294_967_295


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with an order key that grows with their place in the file."""
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("line_no"),
    )


def _content(lines: DataFrame, comments: str = "#") -> DataFrame:
    text = F.trim("value")
    keep = text != ""
    for mark in comments:
        keep = keep & ~text.startswith(mark)
    return lines.withColumn("value", text).filter(keep)


def parse_ip_ranges(lines: DataFrame) -> DataFrame:
    """``start - end , level , description``; ``ok`` is false where the addresses do not parse."""
    halves = F.split("value", " - ", 2)
    fields = F.split("value", " , ", 3)
    start = ip_from_text(F.trim(F.get(halves, F.lit(0))))
    end = ip_from_text(F.trim(F.get(F.split(F.get(halves, F.lit(1)), " , ", 2), F.lit(0))))
    return _content(lines).select(
        start.alias("range_start"),
        end.alias("range_end"),
        F.trim(F.get(fields, F.lit(1))).try_cast("int").alias("level"),
        F.coalesce(F.trim(F.get(fields, F.lit(2))), F.lit("")).alias("description"),
        (start.isNotNull() & end.isNotNull()).alias("ok"),
        "value",
    )


def _u32(text: Column) -> Column:
    number = F.when(F.trim(text).rlike(r"\A[0-9]+\z"), F.trim(text).try_cast("bigint"))
    return F.when(number <= _U32_MAX, number)


def parse_country_ranges(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``start,end,code,name`` -> (ranges, first name per code). The name keeps its commas."""
    parts = F.split("value", ",", 4)
    code = F.upper(F.trim(F.get(parts, F.lit(2))))
    rows = _content(lines).select(
        _u32(F.get(parts, F.lit(0))).alias("range_start"),
        _u32(F.get(parts, F.lit(1))).alias("range_end"),
        F.when(F.octet_length(code) >= 2, F.left(code, F.lit(2))).alias("code"),
        F.trim(F.get(parts, F.lit(3))).alias("name"),
        "line_no",
    ).dropna(subset=["range_start", "range_end", "code", "name"])
    names = rows.groupBy("code").agg(F.min_by("name", "line_no").alias("name"))
    return rows.select("range_start", "range_end", "code"), names


def parse_hash_list(lines: DataFrame) -> DataFrame:
    """One 32-digit hash per line, an optional ``;`` comment behind it."""
    digits = F.trim(F.split_part(F.col("value"), F.lit(";"), F.lit(1)))
    ok = digits.rlike(r"\A[0-9a-fA-F]{32}\z")
    return _content(lines).select(
        F.when(ok, F.lower(digits)).alias("file_hash"), ok.alias("ok"), "value", "line_no"
    )


def parse_terms(lines: DataFrame) -> DataFrame:
    """Lower-cased terms in file order."""
    return _content(lines).select(F.lower("value").alias("term"), "line_no")


def parse_rules(
    lines: DataFrame, *, known_sections: set[str], known_limits: set[str]
) -> tuple[DataFrame, DataFrame]:
    """Sectioned rule file -> (entries, errors).

    A file with any error must be rejected as a whole. ``entries``: section, entry,
    line_no; limits are entries of the section ``limits`` in the form key=value. A
    rule file is an operator's configuration of some hundred lines.
    """
    line = F.col("value")
    header = F.regexp_extract(line, r"\A\[(.*)\]\z", 1)
    is_header = line.rlike(r"\A\[.*\]\z")
    marked = _content(lines, "#;").select(
        "line_no", "value", is_header.alias("is_header"),
        F.when(is_header, F.lower(F.trim(header))).alias("opened"),
    )
    so_far = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marked.withColumn("section", F.last("opened", ignorenulls=True).over(so_far))
    key = F.trim(F.split_part("value", F.lit("="), F.lit(1)))
    number = F.trim(F.split_part("value", F.lit("="), F.lit(2))).try_cast("int")
    problem = (
        F.when(F.col("is_header") & ~F.col("opened").isin(*known_sections, "limits"), F.lit("unknown section"))
        .when(F.col("section").isNull(), F.lit("entry before any section"))
        .when(
            ~F.col("is_header") & (F.col("section") == "limits"),
            F.when(~F.col("value").contains("="), F.lit("expected key = value"))
            .when(~key.isin(*known_limits), F.lit("unknown limit"))
            .when(number.isNull(), F.lit("limit is not a number")),
        )
    )
    judged = placed.withColumn("problem", problem)
    text = F.when(
        F.col("section") == "limits", F.concat(key, F.lit("="), number.cast("string"))
    ).otherwise(F.lower(F.trim(F.split_part("value", F.lit(" ;"), F.lit(1)))))
    # A section header without entries still counts as given, so it is kept with a null entry.
    entries = judged.filter(F.col("problem").isNull()).select(
        "section", F.when(~F.col("is_header"), text).alias("entry"), "line_no"
    ).filter(F.col("entry").isNull() | (F.col("entry") != ""))
    errors = judged.filter(F.col("problem").isNotNull()).select("line_no", "value", "problem")
    return entries, errors


def with_defaults(entries: DataFrame, defaults: DataFrame) -> DataFrame:
    """Sections of the file replace their defaults, the others keep them; (section, entry)."""
    given = entries.select("section").distinct()
    kept = defaults.join(given, "section", "left_anti").select("section", "entry")
    return entries.filter(F.col("entry").isNotNull()).select("section", "entry").unionByName(kept)


def require_valid(entries: DataFrame, errors: DataFrame) -> None:
    """Raise when a rule file must not be used."""
    bad = errors.select("value", "problem").head(1)
    if bad:
        raise ValueError(f"rule file rejected: {bad[0]['problem']}: {bad[0]['value']}")
    if entries.isEmpty():
        raise ValueError("rule file rejected: no sections")

"""One file under unrelated names, size collisions, decoys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalogspark.functions.filetype import size_contradicts_extension
from catalogspark.functions.ordered import first_per_key
from catalogspark.functions.text import words4_bytes, words4_chars
from catalogspark.operators.catalog import order_key

MIN_SIZE = 2 * 1024 * 1024
MAX_NAMES = 12


def admissions(offers: DataFrame, *, min_size: int = MIN_SIZE) -> DataFrame:
    """Files offered under a name that shares no long word with the stored one, and since when.

    The stored name is the file's first. Offers are reduced to their distinct names
    before anything else, combined map-side, which absorbs hot files. Returns
    (file_hash, stored, admitted, size); ``admitted`` is the order key of the
    admitting offer.
    """
    big = F.when(F.col("size") >= min_size, F.struct(order_key().alias("key"), "size"))
    names = offers.groupBy("file_hash", "name").agg(
        F.min(order_key()).alias("first"), F.min(big).alias("first_big")
    )
    stored = names.groupBy("file_hash").agg(F.min_by("name", "first").alias("stored"))
    unrelated = ~F.arrays_overlap(words4_chars(F.col("name")), words4_chars(F.col("stored")))
    return (
        names.filter(F.col("first_big").isNotNull())
        .join(stored, "file_hash")
        .filter((F.col("name") != F.col("stored")) & unrelated)
        .groupBy("file_hash", "stored")
        .agg(F.min("first_big").alias("a"))
        .select("file_hash", "stored", F.col("a.key").alias("admitted"), "a.size")
    )


def alias_records(offers: DataFrame, *, min_size: int = MIN_SIZE, max_names: int = MAX_NAMES) -> DataFrame:
    """Per admitted file: stored name and the next distinct names in order of arrival.

    ``seen`` counts every divergent offer since admission.
    """
    admitted = admissions(offers, min_size=min_size)
    per_name = (
        offers.filter(F.col("size") >= min_size)
        .drop("size")
        .join(admitted, "file_hash")
        .filter((F.col("name") != F.col("stored")) & (order_key() >= F.col("admitted")))
        .groupBy("file_hash", "stored", "size", "name")
        .agg(F.count("*").alias("n"), F.min(order_key()).alias("first"), F.max("ts").alias("last"))
    )
    totals = per_name.groupBy("file_hash").agg(F.sum("n").alias("seen"), F.max("last").alias("last_seen"))
    listed = first_per_key(per_name, ["file_hash"], ["first"], max_names - 1)
    names = listed.groupBy("file_hash", "stored", "size").agg(
        F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("ranked")
    )
    return names.join(totals, "file_hash").select(
        "file_hash",
        F.concat(F.array("stored"), F.col("ranked.name")).alias("names"),
        "seen",
        "size",
        "last_seen",
    )


def unrelated_names(names: Column) -> Column:
    """How many later names share no long word with the first."""
    base = words4_bytes(F.get(names, F.lit(0)))
    rest = F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0)))
    return F.size(F.filter(rest, lambda n: ~F.arrays_overlap(words4_bytes(n), base)))


def any_size_contradiction(names: Column, size: Column) -> Column:
    return F.exists(names, lambda n: size_contradicts_extension(n, size))


def rank_aliases(records: DataFrame, *, top: int = 60, names_shown: int = 6) -> DataFrame:
    """Most unrelated first, then largest."""
    return (
        records.withColumn("unrelated", unrelated_names(F.col("names")))
        .withColumn("size_flag", any_size_contradiction(F.col("names"), F.col("size")))
        .orderBy(F.desc("unrelated"), F.desc("size"), "file_hash")
        .limit(top)
        .withColumn("name_count", F.size("names"))
        .withColumn("names", F.slice("names", 1, names_shown))
    )


def size_campaigns(records: DataFrame, *, groups: int = 20, members: int = 12) -> DataFrame:
    """Tracked files with identical sizes, the largest groups first."""
    sizes = (
        records.groupBy("size").agg(F.count("*").alias("files"))
        .filter(F.col("files") >= 2)
        .orderBy(F.desc("files"), F.desc("size"))
        .limit(groups)
    )
    return first_per_key(records.join(sizes, "size"), ["size"], ["file_hash"], members).select(
        "size", "files", F.col("rank").alias("member"), "file_hash", F.size("names").alias("name_count"),
        unrelated_names(F.col("names")).alias("unrelated"),
    )


def decoys(deduplicated_blocks: DataFrame, *, ban_layer: str = "L3", top: int = 60) -> DataFrame:
    """Ban-list hits that look like someone else's file: unrelated names or an impossible size."""
    scored = (
        deduplicated_blocks.filter(F.col("layer") == ban_layer)
        .withColumn("size_flag", size_contradicts_extension(F.col("name"), F.col("size")))
    )
    return (
        scored.filter((F.col("unrelated") > 0) | F.col("size_flag"))
        .orderBy(F.desc("unrelated"), F.desc("name_count"), "file_hash")
        .limit(top)
    )

"""Source lookup: who offers a file, and under which endpoint id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalogspark.functions import net
from catalogspark.operators.catalog import first_sources

SOURCES_CAP = 200
BATCH_HASHES = 64
BATCH_SOURCES_CAP = 30


def endpoints(source_rows: DataFrame, clients: DataFrame) -> DataFrame:
    """Add ``endpoint_id``: a connected, unreachable user's assigned id, else the id of the address."""
    low = clients.filter(~F.col("is_high_id")).select("user_hash", "assigned_id")
    return (
        source_rows.join(low, "user_hash", "left")
        .withColumn("endpoint_id", F.coalesce("assigned_id", net.endpoint_id(F.col("ip"))))
        .drop("assigned_id")
    )


def _source_lists(source_rows: DataFrame, clients: DataFrame, n: int) -> DataFrame:
    """Per file, its first ``n`` sources as one array; n is a serving cap, so the array is small."""
    first = endpoints(first_sources(source_rows, n), clients)
    return first.groupBy("file_hash").agg(
        F.array_sort(F.collect_list(F.struct("rank", "user_hash", "endpoint_id", "port"))).alias("listed")
    )


def sources_for(
    requests: DataFrame,
    source_rows: DataFrame,
    clients: DataFrame,
    *,
    withheld: DataFrame | None = None,
    cap: int = SOURCES_CAP,
) -> DataFrame:
    """One reply per request: up to ``cap`` sources other than the requester.

    The requester can remove one entry at most, so the first ``cap + 1`` sources of
    a file answer every request for it, and a request meets one row, not all
    sources of a popular file.
    """
    served = source_rows
    if withheld is not None:
        served = served.join(withheld.select("file_hash"), "file_hash", "left_anti")
    lists = _source_lists(served, clients, cap + 1)
    others = F.filter("listed", lambda s: s["user_hash"] != F.col("requester"))
    return requests.join(lists, "file_hash", "left").select(
        "request_id",
        "requester",
        "file_hash",
        F.coalesce(F.slice(others, 1, cap), F.array()).alias("sources"),
    )


def sources_for_batch(
    requests: DataFrame,
    source_rows: DataFrame,
    clients: DataFrame,
    *,
    withheld: DataFrame | None = None,
    max_hashes: int = BATCH_HASHES,
    cap: int = BATCH_SOURCES_CAP,
) -> DataFrame:
    """Requests with an array of hashes: the first ``max_hashes`` are answered, requester included."""
    served = source_rows
    if withheld is not None:
        served = served.join(withheld.select("file_hash"), "file_hash", "left_anti")
    asked = requests.select(
        "request_id", F.posexplode(F.slice("file_hashes", 1, max_hashes)).alias("pos", "file_hash")
    )
    return asked.join(_source_lists(served, clients, cap), "file_hash").select(
        "request_id", "pos", "file_hash", F.col("listed").alias("sources")
    )


def withheld_files(file_rows: DataFrame) -> DataFrame:
    """Files the current verdict hides; expects the ``layer`` column of the screen."""
    return file_rows.filter(F.col("layer").isNotNull()).select("file_hash")


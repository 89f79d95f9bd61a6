"""Sharding by a k-d tree over document metadata.

The items of the tree are groups of equal texts, so copies stay together; only a group of
more than a 16th of a shard is cut (by id) into pieces of about a 64th. An item's
dimensions are its size, its smallest language and its smallest source, each on a scale of
1024 steps with a hash of the text behind it, which orders ties. Every node is split at the
byte-weighted median of its widest dimension until the leaves hold the target bytes, so all
shards get nearly equal bytes.

Medians are found by two rounds of histograms (key prefix, then the rest of the key inside
one prefix) that Spark pre-aggregates before the shuffle; the driver sees one split value
per inner node, a number bounded by the shard count. Slots are numbered per shard in chunks with
offsets, so no shard is ordered in one task.

Defined results: a null text weighs 1 byte and counts as an empty text with text_crc32 0;
null source or language orders first; repeated rows are rows of their own; an empty table
gives an empty result. Extra columns travel in ``row`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import before, table, text_of, written

STEPS = 1024
TAIL_BITS = 22  # hash bits behind the 10 bits of a dimension
DIMS = ("d_size", "d_lang", "d_source")
CHUNK_ROWS = 20_000


def _scaled(units: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its dense rank on a scale of STEPS steps, by a join on distinct values."""
    values = units.select(column).distinct()
    counted = Window.partitionBy()
    ranks = values.select(
        F.col(column).alias("value"),
        ((F.row_number().over(Window.orderBy(F.col(column).asc_nulls_first())) - 1) * STEPS / F.count(F.lit(1)).over(counted)).cast("bigint").alias("step"),
    )
    joined = units.join(ranks, F.col(column).eqNullSafe(F.col("value")))
    return joined.drop(column, "value").withColumnRenamed("step", column)


def _median(node_items: DataFrame) -> dict[int, int]:
    """Per node the key at which half of its bytes is reached; ``node_items`` has node, key, bytes."""
    half = F.sum("bytes").over(Window.partitionBy("node")) / 2
    prefix = F.shiftright("key", 16)
    coarse = node_items.groupBy("node", prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"))
    coarse = coarse.withColumn("ahead", before("bytes", "node", order=["prefix"])).withColumn("half", half)
    coarse = coarse.filter("ahead < half and half <= ahead + bytes").select(F.col("node").alias("at"), F.col("prefix").alias("at_prefix"), "ahead", "half")
    fine = node_items.join(coarse, (F.col("node") == F.col("at")) & (prefix == F.col("at_prefix")))
    fine = fine.groupBy("node", "key").agg(F.sum("bytes").alias("bytes"), F.first("ahead").alias("start"), F.first("half").alias("half"))
    fine = fine.withColumn("ahead", F.col("start") + before("bytes", "node", order=["key"]))
    # Left of the key, or up to and with it, whichever is nearer to one half.
    nearer = F.when(F.col("ahead") + F.col("bytes") / 2 <= F.col("half"), F.col("key") + 1).otherwise(F.col("key"))
    at = fine.filter("ahead < half and half <= ahead + bytes").select("node", nearer.alias("cut"))
    return {r["node"]: r["cut"] for r in at.collect()}  # one row per node of a level


def _key(dim: str) -> Column:
    return F.shiftleft(F.col(dim), TAIL_BITS) + F.col("tail")


def kd_units(slim: DataFrame, shards: int) -> DataFrame:
    """Items (``gkey``, ``piece``) with their shard and the number of pieces of their group.

    ``slim`` has ``gkey``, ``id``, ``size``, ``lang``, ``source``; ``shards`` is a power of two.
    """
    groups = slim.groupBy("gkey").agg(
        F.sum("size").alias("g_bytes"), F.max("size").alias("one"), F.min("lang").alias("d_lang"), F.min("source").alias("d_source"))
    total = groups.agg(F.sum("g_bytes")).first()[0] or 0
    leaf = max(total / shards, 1)
    # A group over 1/16 of a shard is cut in pieces of 1/64 of a shard; pieces take turns by id hash.
    pieces = F.when(F.col("g_bytes") * 16 > leaf, F.ceil(F.col("g_bytes") * 64 / F.lit(leaf))).otherwise(F.lit(1)).cast("int")
    pieces = F.when(F.col("g_bytes") <= F.col("one"), F.lit(1)).otherwise(pieces)  # one document cannot be cut
    groups = groups.withColumn("pieces", pieces)
    groups = groups.withColumn("d_size", F.least(F.lit(STEPS - 1), F.floor(F.log2("one") * 32)).cast("bigint"))
    groups = written(_scaled(_scaled(groups, "d_lang"), "d_source"))
    cut = groups.filter("pieces > 1").select(F.col("gkey").alias("of"), "pieces")
    parts = slim.join(cut, F.col("gkey") == F.col("of")).groupBy("gkey", piece_of().alias("piece")).agg(F.sum("size").alias("bytes"))
    parts = parts.join(groups.drop("g_bytes", "one"), "gkey")
    alone = groups.filter("pieces = 1").select("gkey", F.lit(0).alias("piece"), F.col("g_bytes").alias("bytes"), "pieces", *DIMS)
    items = alone.unionByName(parts.select("gkey", "piece", "bytes", "pieces", *DIMS))
    items = items.withColumn("tail", F.pmod(F.xxhash64("gkey", "piece"), F.lit(1 << TAIL_BITS)))
    items = written(items)

    node = F.lit(0)
    depth = shards.bit_length() - 1
    for level in range(depth):
        placed = items.withColumn("node", node)
        spans = placed.groupBy("node").agg(*[(F.max(d) - F.min(d)).alias(d) for d in DIMS]).collect()
        widest = {r["node"]: max(DIMS, key=lambda d, r=r: r[d]) for r in spans}  # at most 2 ** level nodes
        key = F.lit(0).cast("bigint")
        for n, dim in widest.items():
            key = F.when(F.col("node") == n, _key(dim)).otherwise(key)
        cuts = _median(placed.withColumn("key", key).select("node", "key", "bytes"))
        side = F.lit(0)
        for n, value in cuts.items():
            side = F.when((node == n) & (_key(widest[n]) >= value), 1).otherwise(side)
        items = written(placed.withColumn("node", F.col("node") * 2 + side)) if level + 1 < depth else placed.withColumn("node", F.col("node") * 2 + side)
        node = F.col("node")
    return items.select("gkey", "piece", "pieces", (node if depth else F.lit(0)).cast("int").alias("shard"))


def piece_of() -> Column:
    """The piece of its group that a row belongs to; needs ``id`` and ``pieces``."""
    return F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")


def assign(
    docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str | None = "lang", source_col: str | None = "source",
) -> DataFrame:
    """Per row of ``docs``: id, key (of id and text), size, text_crc32, shard, slot. No text is shuffled."""
    none = F.lit(None).cast("string")
    text = text_of(text_col)
    slim = written(docs.select(
        F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("gkey"),
        (F.col(lang_col) if lang_col else none).alias("lang"), (F.col(source_col) if source_col else none).alias("source")))
    units = written(kd_units(slim.select("gkey", "id", "size", "lang", "source"), shards))
    whole = units.filter("pieces = 1").select(F.col("gkey").alias("of"), "shard")
    # Groups in pieces hold over 1/16 of a shard each, so there are at most 16 per shard.
    cut = units.filter("pieces > 1").groupBy(F.col("gkey").alias("cut_of")).agg(
        F.max("pieces").alias("pieces"), F.map_from_entries(F.collect_list(F.struct("piece", "shard"))).alias("shards"))
    placed = slim.drop("lang", "source").join(F.broadcast(cut), F.col("gkey") == F.col("cut_of"), "left")
    placed = placed.join(whole, F.col("gkey") == F.col("of"), "left")
    placed = placed.withColumn("shard", F.coalesce(F.col("shard"), F.element_at("shards", piece_of())))
    return numbered(placed.select("id", "key", "size", "text_crc32", "gkey", "shard"))


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of a row's id and text."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("~")), text_of(text_col)))


def shard(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """Each row of ``docs`` as struct ``row``, with its shard and slot.

    Rows repeated with one id and text take the places of that key in turn. The texts
    move once, to where their key's places are.
    """
    places = assign(docs, shards, id_col=id_col, text_col=text_col, **columns)
    places = places.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("shard", "slot"))).alias("places"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("key"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    place = F.element_at("places", F.col("turn"))
    return rows.join(places, "key").select("row", place["shard"].alias("shard"), place["slot"].alias("slot"))


def numbered(placed: DataFrame) -> DataFrame:
    """``slot``: 0, 1, 2, ... within each shard, by chunks of rows with offsets."""
    sized = placed.groupBy("shard", F.pmod(F.xxhash64("gkey", "id"), F.lit(1 << 12)).alias("mini")).agg(F.count(F.lit(1)).alias("rows"))
    sized = sized.withColumn("offset", before("rows", "shard", order=["mini"]))
    offsets = sized.select(F.col("shard").alias("of_shard"), F.col("mini").alias("of_mini"), "offset")
    rows = placed.withColumn("mini", F.pmod(F.xxhash64("gkey", "id"), F.lit(1 << 12)))
    rows = rows.join(offsets, (F.col("shard") == F.col("of_shard")) & (F.col("mini") == F.col("of_mini")))
    at = Window.partitionBy("shard", "mini").orderBy("id", "gkey")
    slot = F.col("offset") + F.row_number().over(at) - 1
    return rows.withColumn("slot", slot).select("id", "key", "size", "text_crc32", "shard", "slot")


def op6_shard_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return assign(docs, 16).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))

"""Prefix trie of conversations by fixed-length block hashing.

A conversation is a sequence of turns. A turn at place i has two 64-bit hashes of (its
digest, i); the digest of a prefix is the XOR of its turns' hashes, so digests of blocks
and of chunks of a long conversation combine in any order, in parallel.

1. Conversations are cut into blocks of ``BLOCK_TURNS`` turns. All that pass the same block
   after the same prefix become one row (count, smallest id, the block's turns), so a
   crowd of equal conversations costs one row a block from here on.
2. Where one block follows a prefix alone, no sibling diverges in it: its turns are
   nodes with the block's members. Where several follow, and only there, their turns are
   grouped by prefix digest, each distinct block weighing as many members as it has.
3. Sums over subtrees need no walk over the depth. A node is *owned* by its smallest member.
   The nodes that a conversation owns are the end of its own path, so the sum over the
   subtree of u is the sum of what all members of u own, less what u's owner owns above u.
   That is one more pass over blocks, like the first, with sums in place of counts.

Ids of a node's ends are joined in runs of ``RUN_IDS`` and hashed as a stream, in order.
Running values of a long conversation go chunk by chunk (``ahead``).

Defined results: a null id takes no part; null roles and texts are empty; turns with one
number are ordered by role, then by the MD5 of the text, null numbers first; repeated rows are
turns of their own; an empty table has no nodes. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, text_of, written

BLOCK_TURNS = 4
CHUNK_TURNS = 1024
RUN_IDS_BITS = 12
HEAD_TURNS = 5
PREFIX = ["depth", "pa", "pb"]


def ahead(df: DataFrame, keys: list[str], place: str, sums: dict[str, Column], xors: dict[str, Column], width: int) -> DataFrame:
    """Adds for each row the sum or XOR of values over the rows of its key at smaller places.

    Keys are cut into chunks of ``width`` places; only one row a chunk is ordered within a key.
    """
    given = {**sums, **xors}
    total = {n: F.sum for n in sums} | {n: F.bit_xor for n in xors}
    cut = df.withColumns({"_chunk": F.floor(F.col(place) / width).cast("bigint"), **{f"_v_{n}": c for n, c in given.items()}})
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    by_place = Window.partitionBy(*keys, "_chunk").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    chunks = cut.groupBy(*keys, "_chunk").agg(*[total[n](f"_v_{n}").alias(f"_v_{n}") for n in given])
    chunks = chunks.select(*keys, "_chunk", *[total[n](f"_v_{n}").over(by_chunk).alias(f"_o_{n}") for n in given])

    def both(n: str) -> Column:
        a, b = F.coalesce(f"_o_{n}", F.lit(0)), F.coalesce(total[n](f"_v_{n}").over(by_place), F.lit(0))
        return (a + b if n in sums else a.bitwiseXOR(b)).cast("bigint")

    joined = cut.join(chunks, [*keys, "_chunk"])
    return joined.withColumns({n: both(n) for n in given}).select(*df.columns, *given)


def numbered(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, digest, chars): the turns in order, from place 0, without their texts."""
    role, text = text_of(role_col), text_of(text_col)
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), role.alias("role"),
        F.md5(text).alias("text_md5"), F.char_length(text).cast("bigint").alias("chars"))
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS).cast("bigint"), F.lit(-(1 << 62))))
    within = Window.partitionBy("conv", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text_md5")
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("n"))
    chunks = chunks.select("conv", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = rows.join(chunks, ["conv", "chunk"]).withColumn("place", F.col("before") + F.row_number().over(within) - 1)
    return placed.select("conv", "place", F.md5(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text_md5")).alias("digest"), "chars")


def grafted(rows: DataFrame) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of c - c % 100, then its own after the first h; h = crc32(c) % 6.

    A conversation left without turns has one row without place.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEAD_TURNS + 1))
    heads = rows.filter(F.col("place") < HEAD_TURNS).groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", "chars"))).alias("head"))
    convs = rows.select("conv").distinct().withColumns({"h": h, "base": F.col("conv") - F.col("conv") % 100})
    convs = convs.join(heads, "base", "left").select("conv", "h", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")).alias("head"))
    own = rows.withColumn("h", h).filter("place >= h")
    # The base's turns taken may be fewer than h.
    own = own.join(convs.select("conv", F.size("head").alias("taken")), "conv").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "chars")
    taken = convs.select("conv", F.explode_outer("head").alias("t")).select("conv", "t.place", "t.digest", "t.chars")
    return own.unionByName(taken)


def block_rows(rows: DataFrame, width: int) -> DataFrame:
    """(conv, block, sa, sb, ea, eb, turns): the blocks of every conversation with the prefix digests before and after.

    ``turns`` holds (depth, prefix digest, digest before, chars) of each turn.
    """
    place = F.col("place")
    hashed = rows.filter(place.isNotNull()).select(
        "conv", F.floor(place / width).cast("bigint").alias("block"), F.struct(
            place.alias("at"), F.xxhash64(F.lit(1), "digest", place).alias("a"), F.xxhash64(F.lit(2), "digest", place).alias("b"), "chars").alias("t"))
    blocks = hashed.groupBy("conv", "block").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.bit_xor("t.a").alias("xa"), F.bit_xor("t.b").alias("xb"))
    blocks = ahead(blocks, ["conv"], "block", {}, {"sa": F.col("xa"), "sb": F.col("xb")}, CHUNK_TURNS)
    start = F.array(F.struct((F.get("ts", F.lit(0))["at"]).alias("depth"), F.col("sa").alias("pa"), F.col("sb").alias("pb"), F.lit(0).cast("bigint").alias("qa"), F.lit(0).cast("bigint").alias("qb"), F.lit(0).cast("bigint").alias("chars")))

    def step(acc: Column, t: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct(
            (t["at"] + 1).alias("depth"), last["pa"].bitwiseXOR(t["a"]).alias("pa"), last["pb"].bitwiseXOR(t["b"]).alias("pb"),
            last["pa"].alias("qa"), last["pb"].alias("qb"), t["chars"].alias("chars"))))

    turns = F.aggregate("ts", start, step, lambda acc: F.slice(acc, 2, width))
    return blocks.select("conv", "block", "sa", "sb", F.col("sa").bitwiseXOR(F.col("xa")).alias("ea"), F.col("sb").bitwiseXOR(F.col("xb")).alias("eb"), turns.alias("turns"))


def refined(blocks: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Values of prefixes from values of distinct blocks (alone, turns, ...): grouped by turn only where siblings diverge."""
    turn = ["t.depth", "t.pa", "t.pb", "t.qa", "t.qb", "t.chars"]
    names = list(values)
    alone = blocks.filter("alone").select(F.explode("turns").alias("t"), *names).select(*turn, *names)
    apart = blocks.filter("not alone").select(F.explode("turns").alias("t"), *names).select(*turn, *names)
    apart = apart.groupBy("depth", "pa", "pb", "qa", "qb", "chars").agg(*[c.alias(n) for n, c in values.items()])
    return alone.unionByName(apart)


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(pa, pb, ends_sha256) for (conv, pa, pb): SHA-256 of the ids of each prefix, ascending, comma-joined."""
    run = F.shiftright("conv", RUN_IDS_BITS)
    runs = ends.groupBy("pa", "pb", run.alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    runs = runs.repartition("pa", "pb").sortWithinPartitions("pa", "pb", "run")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), batch.column("ids").to_pylist()):
                if (a, b) == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (a, b), hashlib.sha256(ids.encode())
            yield packed(out)
        if now is not None:
            yield packed([(*now, sha.hexdigest())])

    def packed(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())],
            names=["pa", "pb", "ends_sha256"])

    return runs.select("pa", "pb", "ids").mapInArrow(digest, "pa bigint, pb bigint, ends_sha256 string")


def prefix_trie(rows: DataFrame, *, width: int = BLOCK_TURNS) -> DataFrame:
    """All nodes of the trie of (conv, place, digest, chars); a row without place only names a conversation.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows = written(rows)
    of_conv = written(block_rows(rows, width))
    key = ["block", "sa", "sb", "ea", "eb"]

    # Conversations meet by block; then by turn, where blocks of one prefix differ.
    blocks = of_conv.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"), F.any_value("turns").alias("turns"))
    blocks = written(blocks)
    siblings = blocks.filter("block > 0").groupBy("block", "sa", "sb").agg(F.count(F.lit(1)).alias("of")).filter("of = 1").select("block", "sa", "sb", F.lit(True).alias("single"))
    # All first blocks follow the root: they are siblings.
    blocks = written(blocks.join(siblings, ["block", "sa", "sb"], "left").withColumn("alone", F.coalesce("single", F.lit(False))).drop("single"))
    nodes = written(refined(blocks, {"n": F.sum("n"), "least": F.min("least")}))

    children = nodes.groupBy(F.col("qa").alias("pa"), F.col("qb").alias("pb")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["pa", "pb"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("saves", (F.col("n") - 1) * F.col("chars"))
    nodes = written(ahead(nodes, ["least"], "depth", {"above": F.col("saves")}, {}, CHUNK_TURNS))

    owned = nodes.groupBy(F.col("least").alias("conv")).agg(F.sum("saves").alias("owns"), F.sum((F.col("n_children") == 0).cast("bigint")).alias("leaves"))
    sums = of_conv.select("conv", *key).join(owned, "conv").groupBy(*key).agg(F.sum("owns").alias("owns"), F.sum("leaves").alias("leaves"))
    sums = refined(blocks.drop("n", "least").join(sums, key), {"owns": F.sum("owns"), "leaves": F.sum("leaves")}).select("pa", "pb", "owns", "leaves")

    last = of_conv.groupBy("conv").agg(F.max_by(F.struct(F.col("ea").alias("pa"), F.col("eb").alias("pb")), "block").alias("e"))
    convs = rows.select("conv").distinct().join(last, "conv", "left").select("conv", F.coalesce("e.pa", F.lit(0)).alias("pa"), F.coalesce("e.pb", F.lit(0)).alias("pb"))
    ends = hashed_ends(convs)

    # The root has the empty prefix's digest, two zeros.
    zero = F.lit(0).cast("bigint")
    members = rows.agg(F.min("conv").alias("least"), F.count_distinct("conv").alias("n")).filter("n > 0")
    below = nodes.agg(
        F.coalesce(F.sum("saves"), zero).alias("owns"), F.sum((F.col("depth") == 1).cast("bigint")).alias("n_children"),
        F.sum((F.col("n_children") == 0).cast("bigint")).alias("leaves"))
    # Two tables of one row each, put into one row.
    empty = F.lit(None).cast("bigint")
    root = members.select("n", "least", empty.alias("owns"), empty.alias("n_children"), empty.alias("leaves")).unionByName(
        below.select(empty.alias("n"), empty.alias("least"), "owns", "n_children", "leaves"))
    root = root.agg(*[F.max(c).alias(c) for c in root.columns]).filter("n is not null").select(
        zero.alias("depth"), zero.alias("pa"), zero.alias("pb"), empty.alias("qa"), empty.alias("qb"),
        "n", "least", F.coalesce("n_children", zero).alias("n_children"), zero.alias("above"), "owns", F.greatest(F.coalesce("leaves", zero), F.lit(1)).cast("bigint").alias("leaves"))
    inner = nodes.join(sums, ["pa", "pb"]).select(*root.columns)
    every = inner.unionByName(root)
    parents = nodes.filter("n_children > 0").select(F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("least").alias("parent_conv_id"))
    parents = parents.unionByName(members.select(zero.alias("qa"), zero.alias("qb"), F.col("least").alias("parent_conv_id")))
    nothing = hashlib.sha256(b"").hexdigest()
    return every.join(parents, ["qa", "qb"], "left").join(ends, ["pa", "pb"], "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("owns") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(grafted(written(numbered(turns))))


OP13_SQL = """
WITH o AS (SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
steps AS (SELECT c, list_transform(range(8 * length(CAST(c AS VARCHAR))), lambda k: CASE WHEN k % 8 = 0 THEN CAST(ord(substr(CAST(c AS VARCHAR), CAST(k // 8 + 1 AS INTEGER), 1)) AS BIGINT) ELSE 0 END) AS bytes
  FROM (SELECT DISTINCT c FROM o)),
convs AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda h, b: xor(xor(h, b) >> 1, (xor(h, b) & 1) * 3988292384)), 4294967295::BIGINT) % 6 AS h FROM steps),
head AS (SELECT convs.c, o.p, o.role, o.text FROM convs JOIN o ON o.c = convs.c - convs.c % 100 AND o.p < convs.h),
taken AS (SELECT c, count(*) AS n FROM head GROUP BY c),
r AS (SELECT c, p, role, text FROM head UNION ALL
  SELECT o.c, o.p - convs.h + coalesce(taken.n, 0), o.role, o.text FROM o JOIN convs ON convs.c = o.c AND o.p >= convs.h LEFT JOIN taken ON taken.c = o.c),
k AS (SELECT c, p + 1 AS d, length(text) AS chars, md5(string_agg(md5(concat(length(role), ':', role, text)), '' ORDER BY p) OVER (PARTITION BY c ORDER BY p)) AS key FROM r
  UNION ALL SELECT c, 0, 0, '' FROM convs),
n AS (SELECT d, key, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM k GROUP BY d, key),
up AS (SELECT DISTINCT a.d, a.key, b.key AS parent FROM k a JOIN k b ON a.c = b.c AND b.d = a.d - 1),
kids AS (SELECT d - 1 AS d, parent AS key, count(*) AS n_children FROM up GROUP BY ALL),
sub AS (SELECT DISTINCT a.d, a.key, b.d AS d2, b.key AS key2 FROM k a JOIN k b ON a.c = b.c AND b.d >= a.d),
sums AS (SELECT sub.d, sub.key, CAST(sum((n.n - 1) * n.chars) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE kids.n_children IS NULL) AS n_leaves
  FROM sub JOIN n ON n.d = sub.d2 AND n.key = sub.key2 LEFT JOIN kids ON kids.d = sub.d2 AND kids.key = sub.key2 GROUP BY ALL),
ends AS (SELECT d, key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256 FROM (SELECT c, max(d) AS d, max_by(key, d) AS key FROM k GROUP BY c) GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(kids.n_children, 0) AS n_children, n_leaves, saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN sums ON sums.d = n.d AND sums.key = n.key LEFT JOIN kids ON kids.d = n.d AND kids.key = n.key LEFT JOIN up ON up.d = n.d AND up.key = n.key
LEFT JOIN n parent ON parent.d = n.d - 1 AND parent.key = up.parent LEFT JOIN ends ON ends.d = n.d AND ends.key = n.key
"""

"""A table of boolean searches, answered together.

A query is a tree in postfix order: an array of nodes (op, text, compare, value), see
``postfix``. Every query is first reduced to a *cover*: index keys of which each answer has at
least one. A conjunction takes the cheaper cover of its two sides, a disjunction both,
an exclusion that of its left side, so a cover is never longer than the query; its cost is the
number of index rows it reads. All covers meet the index in one join, and the tree
decides on each candidate by a fold over its nodes. Equal trees are answered once.

Index keys of a file (``search_keys``), one row each:

    t:token    a token of the name            x:ext    the text after the last dot
    g:gram     a bigram or trigram            s:class  the bit length of the size

A tree that nothing narrows is covered by all size classes, that is by all files, as a
single search without a token is a scan.

Answers come in hash order and end at a cap, so a tree with a long cover first meets a short
prefix of the hashes, and those with too few answers yet go on to the next, eight times as long;
the last is everything. How far a tree reads thus depends on how rare its answers are,
not on the number of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalogspark.functions import filetype, text
from catalogspark.operators import grams
from catalogspark.operators.search import RESULT_CAP
from catalogspark.session import cut_lineage

NODE = "op string, text string, compare string, value bigint"
BINARY = ("and", "or", "not")
SIZE_CLASSES = 64
# Ends of the hash prefixes: 1/4096, 1/512, 1/64 and 1/8 of hexadecimal hashes, and the rest. Other
# hashes are answered as well, only their prefixes have other lengths.
PREFIXES = ("001", "008", "04", "2")
# Index rows that a tree may meet at first, per answer asked for.
FIRST_ROWS = 50
# Rows of covers, of some 100 bytes, up to which the covers go to the index rows, and not these to them.
FEW_COVERS = 400_000


def postfix(tree: dict) -> Column:
    """A nested query (see ``search``) as an array of nodes; leaf texts and values may be columns."""

    def column(value: object) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    def node(op: str, of: object = None, compare: str | None = None, value: object = None) -> Column:
        return F.struct(F.lit(op).alias("op"), column(of).cast("string").alias("text"), F.lit(compare).cast("string").alias("compare"), column(value).cast("bigint").alias("value"))

    def nodes(t: dict) -> list[Column]:
        for op in BINARY:
            if op in t:
                left, right = t[op]
                return [*nodes(left), *nodes(right), node(op)]
        if "num" in t:
            return [node("num", t["num"], t["op"], t["value"])]
        (op, of), = t.items()
        return [node(op, of)]

    return F.array(*nodes(tree))


def size_class(size: Column) -> Column:
    """Number of binary digits; a negative size has all."""
    return F.length(F.bin(size))


def search_keys(file_rows: DataFrame) -> DataFrame:
    """One row per (key, file_hash): all that a query can be looked up by."""
    lowered = F.lower("name")
    each = lambda prefix, values: F.transform(values, lambda v: F.concat(F.lit(prefix), v))
    keys = F.concat(
        each("t:", text.tokens(F.col("name"))), each("g:", F.concat(*[grams.grams(lowered, n) for n in grams.SIZES])),
        F.array(F.concat(F.lit("x:"), filetype.last_part(lowered)), F.concat(F.lit("s:"), size_class(F.col("size")).cast("string"))))
    return file_rows.select(F.explode(keys).alias("key"), "file_hash").filter(F.col("key").isNotNull())


def key_counts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count("*").alias("n"))


def _classes(low: Column, high: Column) -> Column:
    """Size classes of a range of binary lengths, and those of negative sizes."""
    inner = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return F.transform(inner, lambda c: F.concat(F.lit("s:"), c.cast("string")))


def _leaf(node: Column) -> Column:
    """A leaf with all that is fixed before any name is seen: words, tokens, extensions and possible covers."""
    op, low = node["op"], F.lower(node["text"])
    none = F.array().cast("array<string>")
    spaced = F.filter(F.split(low, r"[\p{IsWhite_Space}]+"), lambda w: w != "")
    words = F.when((op != "term") | low.isin("*", "**", ""), none).when(low.contains(" "), spaced).otherwise(F.array(low))
    tokens = F.when(op == "term", text.tokens(node["text"])).otherwise(none)
    known = F.create_map(*[x for name, (_, ext) in filetype.TYPES.items() for x in (F.lit(name), F.array(*map(F.lit, ext.split())))])
    extensions = F.when(op == "type", F.try_element_at(known, low))

    def lookups(of_words: Column) -> Column:
        of_word = lambda w: F.concat(grams.grams(w, 3), F.when(F.char_length(w) == 2, F.array(w)).otherwise(none))
        return F.transform(F.flatten(F.transform(of_words, of_word)), lambda g: F.array(F.concat(F.lit("g:"), g)))

    everything = _classes(F.lit(1), F.lit(SIZE_CLASSES))
    bits, all_bits = size_class(node["value"]).cast("int"), F.lit(SIZE_CLASSES)
    of_size = (
        F.when(~low.isin("size", "filesize") | (node["compare"] == "!="), everything)
        .when(node["compare"] == "=", F.array(F.concat(F.lit("s:"), bits.cast("string"))))
        .when(node["compare"].isin("<", "<="), F.array_union(_classes(F.lit(1), bits), _classes(all_bits, all_bits)))
        .otherwise(_classes(F.when(node["value"] < 0, F.lit(1)).otherwise(bits), all_bits)))
    nothing = F.array().cast("array<array<string>>")
    by_word = F.when(op == "term", F.transform(tokens, lambda t: F.array(F.concat(F.lit("t:"), t)))).otherwise(nothing)
    by_name = (
        F.when(op == "term", lookups(words)).when(op == "meta", lookups(F.array(low)))
        .when(op == "format", F.array(F.array(F.concat(F.lit("x:"), low))))
        .when(extensions.isNotNull(), F.array(F.transform(extensions, lambda e: F.concat(F.lit("x:"), e))))
        .when(op == "num", F.array(of_size)).otherwise(nothing))

    def options(given: Column) -> Column:
        return F.when(op.isin(*BINARY) | (F.size(given) > 0), given).otherwise(F.array(everything))

    return F.struct(
        op.alias("op"), low.alias("low"), node["compare"].alias("compare"), node["value"].alias("value"),
        words.alias("words"), tokens.alias("tokens"), extensions.alias("extensions"),
        options(by_word).alias("by_word"), options(by_name).alias("by_name"))


def _fold(nodes: Column, zero: str, leaf, combine) -> Column:
    """The value of a tree in postfix order, over a stack."""

    def step(stack: Column, node: Column) -> Column:
        n = F.size(stack)
        left, right = F.get(stack, n - 2), F.get(stack, n - 1)
        return F.when(
            node["op"].isin(*BINARY), F.concat(F.slice(stack, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(combine(node["op"], left, right)))
        ).otherwise(F.concat(stack, F.array(leaf(node))))

    return F.get(F.aggregate(nodes, F.array().cast(f"array<{zero}>"), step), F.lit(0))


def costed_cover(nodes: Column, counts: Column) -> Column:
    """(cost, keys): the cheapest index keys of which every answer has one; ``counts`` maps keys to their numbers of files.

    An answer has enough whole words, and its name answers the tree. These may be due to different
    sides of a disjunction, so a cover follows from the one or from the other, never from both.
    """

    def cost(keys: Column) -> Column:
        return F.aggregate(keys, F.lit(0).cast("bigint"), lambda acc, k: acc + F.coalesce(F.try_element_at(counts, k), F.lit(0)))

    def combine(op: Column, left: Column, right: Column) -> Column:
        both = F.struct((left["cost"] + right["cost"]).alias("cost"), F.array_union(left["keys"], right["keys"]).alias("keys"))
        return F.when(op == "and", F.least(left, right)).when(op == "or", both).otherwise(left)

    def of(kind: str) -> Column:
        leaf = lambda node: F.array_min(F.transform(node[kind], lambda o: F.struct(cost(o).alias("cost"), o.alias("keys"))))
        return _fold(nodes, "struct<cost:bigint,keys:array<string>>", leaf, combine)

    return F.least(of("by_word"), of("by_name"))


def cover(nodes: Column, counts: Column) -> Column:
    """The keys alone."""
    return costed_cover(nodes, counts)["keys"]


def accepts(nodes: Column, lowered: Column, words: Column, size: Column) -> Column:
    """Whether a name answers the tree, and has the whole words of enough of its terms.

    The fold carries two bits: 1 for the tree itself, 2 for the words.
    """
    extension = filetype.last_part(lowered)

    def leaf(node: Column) -> Column:
        op, value = node["op"], node["value"]
        compared = (
            F.when(~node["low"].isin("size", "filesize"), F.lit(True))
            .when(node["compare"] == "=", size == value).when(node["compare"] == "!=", size != value)
            .when(node["compare"] == ">", size > value).when(node["compare"] == "<", size < value)
            .when(node["compare"] == ">=", size >= value).otherwise(size <= value))
        true = (
            F.when(op == "term", F.forall(node["words"], lambda w: lowered.contains(w)))
            .when(op == "meta", lowered.contains(node["low"])).when(op == "format", extension == node["low"])
            .when(op == "type", lowered.contains(".") & F.coalesce(F.array_contains(node["extensions"], extension), F.lit(True)))
            .otherwise(compared))
        whole = (op != "term") | (F.size(F.array_except(node["tokens"], words)) == 0)
        return F.coalesce(true.cast("int"), F.lit(0)) + 2 * whole.cast("int")

    def combine(op: Column, left: Column, right: Column) -> Column:
        without = left.bitwiseAND(F.lit(2) + F.lit(1) - right.bitwiseAND(F.lit(1)))
        return F.when(op == "and", left.bitwiseAND(right)).when(op == "or", left.bitwiseOR(right)).otherwise(without)

    return _fold(nodes, "int", leaf, combine) == 3


def _level(file_hash: Column) -> Column:
    """Number of the first prefix that holds a hash."""
    level = F.lit(len(PREFIXES))
    for i, end in reversed(list(enumerate(PREFIXES))):
        level = F.when(file_hash < end, i).otherwise(level)
    return level


def batch_trees(
    file_rows: DataFrame,
    keys: DataFrame,
    queries: DataFrame,
    *,
    withheld: DataFrame | None = None,
    source_rows: DataFrame | None = None,
    cap: int = RESULT_CAP,
) -> DataFrame:
    """Answer a table of queries (query_id, nodes): (query_id, rank, file_hash, name, size).

    As ``search`` once per tree. ``keys`` are the files' ``search_keys``. A null or
    empty tree has no answers.
    """
    asked = queries.filter(F.size("nodes") > 0).select("query_id", F.col("nodes").cast(f"array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>").alias("nodes"))
    asked = asked.withColumn("tree", F.md5(F.to_json("nodes")))
    trees = asked.groupBy("tree").agg(F.first("nodes").alias("nodes")).select("tree", F.transform("nodes", _leaf).alias("nodes"))

    possible = trees.select("tree", F.explode(F.array_distinct(F.flatten(F.concat(
        F.flatten(F.col("nodes.by_word")), F.flatten(F.col("nodes.by_name")))))).alias("key"))
    lengths = key_counts(keys.join(possible.select("key").distinct(), "key", "left_semi"))
    counts = possible.join(lengths, "key").groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("counts"))
    nothing = F.create_map().cast("map<string,bigint>")
    chosen = trees.join(counts, "tree", "left").select("tree", "nodes", costed_cover(F.col("nodes"), F.coalesce("counts", nothing)).alias("c"))
    start = F.lit(0)
    for i in range(1, len(PREFIXES) + 1):
        start = F.when(F.col("c.cost") <= FIRST_ROWS * cap * 8 ** (len(PREFIXES) - i), i).otherwise(start)
    # Trees get numbers here, which are far narrower than their digests; what led to the cover is not needed any more.
    nodes = F.transform("nodes", lambda n: n.dropFields("by_word", "by_name"))
    numbered = cut_lineage(chosen.select(
        "tree", F.monotonically_increasing_id().alias("id"), start.alias("start"), F.col("c.keys").alias("keys"), nodes.alias("nodes")))
    sizes = numbered.agg(F.min("start").alias("first"), F.sum(F.size("keys") * (F.col("start") + 1)).alias("rows")).head()
    covers, trees = numbered.select("id", "start", F.explode("keys").alias("key")), numbered.select("id", "nodes")
    few = (sizes["rows"] or 0) <= FEW_COVERS
    first = len(PREFIXES) if sizes["first"] is None else sizes["first"]

    served = file_rows.select("file_hash", "name", "size")
    if withheld is not None:
        served = served.join(withheld.select("file_hash"), "file_hash", "left_anti")
    if source_rows is not None:
        served = served.join(source_rows.select("file_hash").distinct(), "file_hash", "left_semi")
    if first < len(PREFIXES):
        served = cut_lineage(served)
    words = F.split(F.lower("name"), text.SEPARATORS)
    best = None
    for level in range(first, len(PREFIXES) + 1):
        reached = (lambda rows: rows) if level == len(PREFIXES) else (lambda rows: rows.filter(F.col("file_hash") < PREFIXES[level]))  # noqa: B023
        # A tree that has begun meets only the new part.
        below = F.when(F.col("start") == level, F.sequence(F.lit(0), F.lit(level))).otherwise(F.array(F.lit(level)))
        turn = covers.filter(F.col("start") <= level)
        if best is not None:
            turn = turn.join(best.groupBy("id").count().filter(F.col("count") >= cap), "id", "left_anti")
            if turn.isEmpty():
                continue
        turn = turn.select("id", "key", F.explode(below).alias("level"))
        placed = reached(keys.select("key", "file_hash")).withColumn("level", _level(F.col("file_hash")))
        # Index rows stay where they are if the covers are few. A pair moves once, to its file; pairs met by several keys are told apart at the end.
        met = placed.join(F.broadcast(turn) if few else turn, ["key", "level"]).select("id", "file_hash")
        hits = (
            met.join(reached(served), "file_hash").join(trees, "id")
            .filter(accepts(F.col("nodes"), F.lower("name"), words, F.col("size")))
            .select("id", "file_hash")
        )
        found = hits if best is None else hits.unionByName(best.drop("rank"))
        ranked = found.withColumn("rank", F.dense_rank().over(Window.partitionBy("id").orderBy("file_hash")))
        best = ranked.filter(F.col("rank") <= cap).distinct()
        if level < len(PREFIXES):
            best = cut_lineage(best)
    answers = asked.join(numbered.select("tree", "id"), "tree").join(best, "id")
    return answers.join(served, "file_hash").select("query_id", "rank", "file_hash", "name", "size")

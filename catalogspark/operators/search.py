"""Boolean search over the catalog, single and in bulk.

A query is a nested dict:

    {"and": [a, b]}  {"or": [a, b]}  {"not": [a, b]}      (a without b)
    {"term": "red rod"}                                    words, any order
    {"type": "video"}  {"format": "mkv"}  {"meta": "x"}    text conditions
    {"num": "size", "op": ">", "value": 1000}              numeric condition
"""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from catalogspark.functions import filetype, net
from catalogspark.functions.ordered import first_per_key
from catalogspark.functions.text import MIN_TOKEN_BYTES, SEPARATORS, STOP_WORDS
from catalogspark.operators import grams
from catalogspark.operators.catalog import first_sources, source_counts
from catalogspark.operators.index import token_counts

RESULT_CAP = 200
SHORT_CAP = 10
_COMPARE = {
    "=": operator.eq, "!=": operator.ne, ">": operator.gt,
    "<": operator.lt, ">=": operator.ge, "<=": operator.le,
}
# The same class for driver-side terms: Python's \s with the remaining Unicode spaces.
_PY_SEPARATORS = re.compile(SEPARATORS.replace(r"\p{IsWhite_Space}", r"\s"))


def term_tokens(term: str) -> list[str]:
    """Index keys of one search term, by the tokenizer the index was built with."""
    bare = term.strip()
    if bare in ("*", "**"):
        return [bare]
    found = [
        t for t in _PY_SEPARATORS.split(bare.lower())
        if len(t.encode()) >= MIN_TOKEN_BYTES and t not in STOP_WORDS
    ]
    return found or ([bare.lower()] if bare else [])


def positive_terms(tree: dict, negated: bool = False) -> list[str]:
    """Terms that are not on the excluded side of an odd number of exclusions."""
    if "term" in tree:
        return [] if negated else [tree["term"]]
    for op in ("and", "or"):
        if op in tree:
            left, right = tree[op]
            return positive_terms(left, negated) + positive_terms(right, negated)
    if "not" in tree:
        left, right = tree["not"]
        return positive_terms(left, negated) + positive_terms(right, not negated)
    return []


def predicate(tree: dict, name_lower: Column, size: Column) -> Column:
    """The whole tree as one Boolean column."""
    for op, combine in (("and", operator.and_), ("or", operator.or_)):
        if op in tree:
            left, right = tree[op]
            return combine(predicate(left, name_lower, size), predicate(right, name_lower, size))
    if "not" in tree:
        left, right = tree["not"]
        return predicate(left, name_lower, size) & ~predicate(right, name_lower, size)
    if "term" in tree:
        term = tree["term"].lower()
        if term in ("*", "**", ""):
            return F.lit(True)
        words = term.split() if " " in term else [term]
        return reduce(operator.and_, [name_lower.contains(w) for w in words], F.lit(True))
    if "type" in tree:
        return filetype.has_type(name_lower, tree["type"])
    if "format" in tree:
        return filetype.last_part(name_lower) == tree["format"].lower()
    if "meta" in tree:
        return name_lower.contains(tree["meta"].lower())
    if "num" in tree:
        if tree["num"].lower() not in ("size", "filesize"):
            return F.lit(True)  # not kept per file, so it never excludes
        return _COMPARE[tree["op"]](size, F.lit(tree["value"]))
    raise ValueError(f"unknown query node: {sorted(tree)}")


def _narrowing(tree: dict, compat: bool) -> list[frozenset[str]] | None:
    """Token sets of which a candidate must contain at least one set completely.

    None means the index cannot narrow this query. Stop words and one-byte terms
    are never indexed, so they do not narrow; ``compat`` keeps them, and requires
    the words of both sides of an OR.
    """

    def leaf(term: str) -> frozenset[str]:
        keys = [t for t in term_tokens(term) if t not in ("*", "**")]
        if compat:
            return frozenset(keys)
        return frozenset(t for t in keys if len(t.encode()) >= MIN_TOKEN_BYTES and t not in STOP_WORDS
                         and not _PY_SEPARATORS.search(t))

    if compat:
        keys = frozenset().union(*[leaf(t) for t in positive_terms(tree)])
        return [keys] if keys else None

    def sets(node: dict) -> list[frozenset[str]]:
        if "term" in node:
            return [leaf(node["term"])]
        if "and" in node:
            left, right = map(sets, node["and"])
            return list({a | b for a in left for b in right})
        if "or" in node:
            left, right = map(sets, node["or"])
            return list({*left, *right})
        if "not" in node:
            return sets(node["not"][0])
        return [frozenset()]

    alternatives = sets(tree)
    return None if frozenset() in alternatives else alternatives


def candidates(posting_rows: DataFrame, alternatives: list[frozenset[str]]) -> DataFrame:
    """Files containing all tokens of at least one alternative: (file_hash, found)."""
    wanted = sorted(frozenset().union(*alternatives))
    flags = posting_rows.filter(F.col("token").isin(*wanted)).groupBy("file_hash").agg(
        *[F.bool_or(F.col("token") == t).alias(f"t{i}") for i, t in enumerate(wanted)]
    )
    has = {t: F.col(f"t{i}") for i, t in enumerate(wanted)}
    any_set = [reduce(operator.and_, [has[t] for t in sorted(s)]) for s in alternatives]
    return flags.select("file_hash", reduce(operator.or_, any_set).alias("found")).filter("found")


def search(
    file_rows: DataFrame,
    posting_rows: DataFrame,
    source_rows: DataFrame | None,
    tree: dict,
    *,
    withheld: DataFrame | None = None,
    cap: int = RESULT_CAP,
    match: str = "token",
    compat: bool = False,
    max_scan: int | None = None,
    short: bool = False,
    gram_rows: DataFrame | None = None,
) -> DataFrame:
    """Files that answer the query, the first ``cap`` by hash.

    Whole tokens narrow the candidates, then the tree decides on the name; with
    ``match='substring'``, or when no token narrows, the tree alone decides. Then
    ``gram_rows`` (see ``grams``) narrow the candidates, where a word of the query has
    grams, so that names are not scanned. ``short`` answers nothing without a token and at most ten rows. ``max_scan``
    bounds the rows an unnarrowed query may look at, making its answer partial.
    Without ``source_rows`` every file is taken to have a source, as it has after
    eviction.
    """
    alternatives = _narrowing(tree, compat)
    if short:
        cap = min(cap, SHORT_CAP)
        if alternatives is None:
            return file_rows.limit(0)
    decides = predicate(tree, F.lower("name"), F.col("size"))
    found = None
    if alternatives is not None and match == "token":
        found = candidates(posting_rows, alternatives)
    elif gram_rows is not None:
        found = grams.candidates(gram_rows, tree)
    if found is not None:
        # Bound to a column of the other side, the test is not moved below the join, to all names.
        hits = file_rows.join(found, "file_hash").filter(F.when(F.col("found"), decides)).drop("found")
    else:
        hits = (file_rows if max_scan is None else file_rows.limit(max_scan)).filter(decides)
    if withheld is not None:
        hits = hits.join(withheld.select("file_hash"), "file_hash", "left_anti")
    if source_rows is not None:
        hits = hits.join(source_rows.select("file_hash"), "file_hash", "left_semi")
    return hits.orderBy("file_hash").limit(cap)


def project_results(hits: DataFrame, source_rows: DataFrame) -> DataFrame:
    """Result records: first source, split size, counts, type id (null when unknown)."""
    of_hits = source_rows.join(hits.select("file_hash"), "file_hash", "left_semi")
    first = first_sources(of_hits, 1).select(
        "file_hash", F.col("ip").alias("source_ip"), F.col("port").alias("source_port")
    )
    kind = filetype.type_id(F.lower("name"))
    return (
        hits.join(first, "file_hash", "left")
        .join(source_counts(of_hits), "file_hash", "left")
        .select(
            "file_hash",
            F.coalesce("source_ip", F.lit(0)).alias("source_ip"),
            F.coalesce("source_port", F.lit(0)).alias("source_port"),
            "name",
            net.size_low(F.col("size")).alias("size_low"),
            net.size_high(F.col("size")).alias("size_high"),
            F.coalesce("sources", F.lit(0)).alias("sources"),
            F.coalesce("complete_sources", F.lit(0)).alias("complete_sources"),
            F.nullif(kind, F.lit(0)).alias("type_id"),
        )
    )


def batch_search(
    file_rows: DataFrame,
    posting_rows: DataFrame,
    queries: DataFrame,
    *,
    withheld: DataFrame | None = None,
    source_rows: DataFrame | None = None,
    cap: int = RESULT_CAP,
) -> DataFrame:
    """Answer a table of queries (query_id, tokens) together.

    Every query is looked up by its rarest token only, and its other tokens are
    tested on the name of each candidate, so a frequent word costs nothing unless
    it is the best a query has. Equal queries are answered once. Returns
    (query_id, rank, file_hash, name, size).
    """
    needs = queries.select("query_id", F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    asked = needs.select("tokens").distinct()
    wanted = asked.select("tokens", F.explode("tokens").alias("token"))
    lengths = token_counts(posting_rows.join(wanted.select("token").distinct(), "token", "left_semi"))
    seeds = (
        wanted.join(lengths, "token", "left")
        .groupBy("tokens")
        .agg(F.min_by("token", F.struct(F.coalesce("postings", F.lit(0)), "token")).alias("token"))
    )
    served = file_rows
    if withheld is not None:
        served = served.join(withheld.select("file_hash"), "file_hash", "left_anti")
    if source_rows is not None:
        served = served.join(source_rows.select("file_hash"), "file_hash", "left_semi")
    words = F.split(F.lower("name"), SEPARATORS)
    hits = (
        posting_rows.join(seeds, "token")
        .select("tokens", "file_hash")
        .join(served.select("file_hash", "name", "size"), "file_hash")
        .filter(F.size(F.array_except("tokens", words)) == 0)
    )
    best = first_per_key(hits, ["tokens"], ["file_hash"], cap)
    return needs.join(best, "tokens").select("query_id", "rank", "file_hash", "name", "size")


def paginate(ranked: DataFrame, *, page_size: int, keys: list[str]) -> DataFrame:
    """Page numbers over ranked results, and whether a further page follows.

    The rows of a key are a capped result, so the count per key is small.
    """
    totals = ranked.groupBy(*keys).agg(F.max("rank").alias("__total"))
    page = F.floor((F.col("rank") - 1) / page_size).cast("int") + 1
    return (
        ranked.join(totals, keys)
        .withColumn("page", page)
        .withColumn("has_more", F.col("__total") > F.col("page") * page_size)
        .drop("__total")
    )

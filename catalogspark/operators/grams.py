"""Substring search over an index of character n-grams.

A name that contains a word contains all of the word's n-grams. Files are therefore
found by the rarest gram of each word that the query needs, and only their names are tested.
Words of three characters and more go by trigrams, words of two by bigrams; a single
character narrows nothing.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from catalogspark.functions import filetype
from catalogspark.operators.catalog import write_bucketed

SIZES = (2, 3)
#: In a conjunction, a list so many times longer than the shortest one is not read: testing the names costs less.
WORTHWHILE = 16

# A candidate condition: None (no narrowing), ("gram", g), ("and", [...]) or ("or", [...]).
Condition = tuple | None


def grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters."""
    last = F.char_length(text) - n + 1
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def gram_postings(named: DataFrame, *, id_col: str = "file_hash", text_col: str = "name") -> DataFrame:
    """One row per (gram, id), of the lowered text. Distinctness is settled inside the row, without a shuffle."""
    lowered = F.lower(text_col)
    return named.select(F.explode(F.concat(*[grams(lowered, n) for n in SIZES])).alias("gram"), id_col)


def write_gram_postings(rows: DataFrame, table: str, *, buckets: int) -> None:
    """Save gram postings bucketed and sorted by gram, so a lookup reads the buckets of its grams."""
    write_bucketed(rows, table, key="gram", buckets=buckets, sort=["gram", "file_hash"])


def gram_counts(rows: DataFrame) -> DataFrame:
    """Length of every gram's list."""
    return rows.groupBy("gram").agg(F.count("*").alias("postings"))


def word_grams(word: str) -> list[str]:
    """The grams by which a word is looked up."""
    n = min(len(word), max(SIZES))
    return sorted({word[i:i + n] for i in range(len(word) - n + 1)}) if n >= min(SIZES) else []


def needed(tree: dict) -> tuple | None:
    """What every answer contains: ("word", w), ("and", [...]), ("or", [...]), or None for anything."""

    def conjunction(parts: list) -> tuple | None:
        parts = [p for p in parts if p is not None]
        return ("and", parts) if len(parts) > 1 else parts[0] if parts else None

    if "and" in tree:
        return conjunction([needed(t) for t in tree["and"]])
    if "or" in tree:
        parts = [needed(t) for t in tree["or"]]
        return None if None in parts else ("or", parts)
    if "not" in tree:
        return needed(tree["not"][0])
    if "term" in tree:
        term = tree["term"].lower()
        words = [] if term in ("*", "**") else term.split() if " " in term else [term]
        return conjunction([("word", w) if word_grams(w) else None for w in words])
    if "meta" in tree or "format" in tree:
        word = (tree["meta"] if "meta" in tree else tree["format"]).lower()
        return ("word", word) if word_grams(word) else None
    if "type" in tree:
        known = filetype.TYPES.get(tree["type"].lower())
        return ("or", [("word", f".{e}") for e in known[1].split()]) if known else None
    return None


def grams_in(need: tuple | None) -> set[str]:
    """All grams by which the needed words could be looked up."""
    if need is None:
        return set()
    kind, value = need
    return set(word_grams(value)) if kind == "word" else set().union(*map(grams_in, value))


def condition(need: tuple | None, counts: dict[str, int]) -> tuple[Condition, int]:
    """Which lists to read for the needed words, and how many rows that is."""
    if need is None:
        return None, 0
    kind, value = need
    if kind == "word":
        n, gram = min((counts.get(g, 0), g) for g in word_grams(value))
        return ("gram", gram), n
    parts = [condition(p, counts) for p in value]
    if kind == "and":
        least = min(n for _, n in parts)
        parts = [(c, n) for c, n in parts if n <= WORTHWHILE * least]
    return (kind, [c for c, _ in parts]), sum(n for _, n in parts)


def candidates(gram_rows: DataFrame, tree: dict) -> DataFrame | None:
    """Files that have the rarest grams of the words a query needs, (file_hash, found); None when nothing narrows it.

    The lengths of the query's own lists, a bounded number, are looked up first.
    """
    need = needed(tree)
    if need is None:
        return None
    asked = sorted(grams_in(need))
    counts = {r["gram"]: r["postings"] for r in gram_counts(gram_rows.filter(F.col("gram").isin(*asked))).collect()}
    wanted, _ = condition(need, counts)
    read = sorted(_grams_of(wanted))
    rows = gram_rows.filter(F.col("gram").isin(*read))
    if len(read) == 1:
        return rows.select("file_hash", (F.col("gram") == read[0]).alias("found"))
    flags = rows.groupBy("file_hash").agg(*[F.bool_or(F.col("gram") == g).alias(f"g{i}") for i, g in enumerate(read)])
    has = {g: F.col(f"g{i}") for i, g in enumerate(read)}

    def column(c: tuple) -> Column:
        kind, value = c
        return has[value] if kind == "gram" else reduce(operator.and_ if kind == "and" else operator.or_, map(column, value))

    return flags.select("file_hash", column(wanted).alias("found")).filter("found")


def _grams_of(c: tuple) -> set[str]:
    kind, value = c
    return {value} if kind == "gram" else set().union(*map(_grams_of, value))

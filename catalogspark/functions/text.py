"""Tokens, word sets, bounded term patterns and name repair as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Word separators, minimum token length in bytes, stop words.
SEPARATORS = r"""[\p{IsWhite_Space}_\-.,;()\[\]{}!?@#$%^&*+=/\\|<>"'`~]"""
MIN_TOKEN_BYTES = 2
STOP_WORDS = (
    "the", "and", "for", "with", "from", "this", "that",
    "web", "www", "com", "net", "org",
)

NON_WORD = r"[^\p{IsAlphabetic}\p{N}]+"


def is_token(token: Column) -> Column:
    """Long enough in bytes and not a stop word."""
    return (F.octet_length(token) >= MIN_TOKEN_BYTES) & ~token.isin(*STOP_WORDS)


def tokens(name: Column) -> Column:
    """Distinct indexable tokens of a name, in order of appearance."""
    return F.filter(F.array_distinct(F.split(F.lower(name), SEPARATORS)), is_token)


def search_term_tokens(term: Column) -> Column:
    """Index keys of one search term held in a column.

    Wildcards stay as they are; a term that leaves no token keeps its lowered
    text; a blank term gives no key.
    """
    bare = F.trim(term)
    found = tokens(bare)
    return (
        F.when(bare.isin("*", "**"), F.array(bare))
        .when(F.size(found) > 0, found)
        .when(bare == "", F.array().cast("array<string>"))
        .otherwise(F.array(F.lower(bare)))
    )


def words4_chars(name: Column) -> Column:
    """Lower-cased words of at least four characters."""
    return F.filter(F.split(F.lower(name), NON_WORD), lambda w: F.char_length(w) >= 4)


def words4_bytes(name: Column) -> Column:
    """Lower-cased words of at least four bytes."""
    return F.filter(F.split(F.lower(name), NON_WORD), lambda w: F.octet_length(w) >= 4)


def fnv1a32(token: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a non-negative bigint."""
    raw = F.hex(F.encode(token, "UTF-8"))
    indexes = F.when(F.octet_length(token) > 0, F.sequence(F.lit(1), F.octet_length(token))).otherwise(
        F.array().cast("array<int>")
    )

    def step(acc: Column, i: Column) -> Column:
        byte = F.conv(F.substring(raw, (i - 1) * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
        return (acc.bitwiseXOR(byte) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))

    return F.aggregate(indexes, F.lit(2166136261).cast("bigint"), step)


# ---------------------------------------------------------------------------
# Bounded terms. Names are lowered before these patterns are applied.

_EDGE = re.compile(r"[A-Za-z0-9_]", re.ASCII)
FREE_RIGHT_MIN_CHARS = 6


def quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", text)


def term_pattern(term: str) -> str:
    """Pattern of one list entry.

    The left side may not follow a letter. Entries of six or more characters may
    run on to the right, shorter ones may not run into a letter, and a trailing
    ``$`` asks for a full word end. Each side counts only where the entry itself
    has an ASCII word character there.
    """
    anchored = term.endswith("$") and len(term) > 1
    text = term[:-1] if anchored else term
    left = r"(?<![A-Za-z])" if _EDGE.match(text[0]) else ""
    right = ""
    if _EDGE.match(text[-1]):
        if anchored:
            right = r"(?![A-Za-z0-9_])"
        elif len(text) < FREE_RIGHT_MIN_CHARS:
            right = r"(?![A-Za-z])"
    return f"{left}{quote(text)}{right}"


def prefix_pattern(term: str) -> str:
    """Left-bounded: the term starts a word and may run on."""
    return rf"(?<![A-Za-z0-9_]){quote(term)}"


def bounded_pattern(term: str) -> str:
    """Bounded on both sides."""
    return rf"(?<![A-Za-z0-9_]){quote(term)}(?![A-Za-z0-9_])"


def plain_pattern(term: str) -> str:
    """Substring, as for scripts written without word separators."""
    return quote(term)


def any_of(patterns: list[str]) -> str | None:
    """One alternation over many patterns, or None for an empty list."""
    return "(?:" + "|".join(patterns) + ")" if patterns else None


def first_matching_term(lowered: Column, terms: list[str]) -> Column:
    """The first list entry found in the name, verbatim, else null.

    One alternation rejects the many names without any entry; only a name that
    has one pays for finding which entry comes first in the list.
    """
    kept = [t for t in terms if t]
    if not kept:
        return F.lit(None).cast("string")
    entries = F.array(
        *[F.struct(F.lit(t).alias("term"), F.lit(term_pattern(t)).alias("pattern")) for t in kept]
    )
    hits = F.filter(entries, lambda e: F.regexp_like(lowered, e["pattern"]))
    return F.when(lowered.rlike(any_of([term_pattern(t) for t in kept])), F.get(hits, F.lit(0))["term"])


def repair_round(name: Column) -> Column:
    """Undo one round of UTF-8 read as Latin-1; null when that is not the explanation."""
    suspicious = name.rlike(r"[^\x00-\x7F]") & name.rlike(r"\A[\x00-\xFF]*\z")
    decoded = F.when(
        suspicious, F.try_validate_utf8(F.encode(name, "ISO-8859-1").cast("string"))
    )
    return F.when(decoded != name, decoded)


def repair_double_encoding(name: Column) -> Column:
    """Undo up to two rounds of UTF-8 read as Latin-1; null when nothing changes."""
    first = repair_round(name)
    return F.coalesce(repair_round(first), first)

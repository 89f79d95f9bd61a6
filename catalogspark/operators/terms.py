"""Term lists of any length as tables.

``first_matching_term`` puts a short list into the plan as one pattern. Here a list is a
table (ord, term): every entry has an *anchor*, the run of up to three characters of it that
the fewest names contain; names are cut into their runs, runs meet anchors in an equi-join,
and the entry is verified at the place where its anchor stands. The join carries a place,
so verification compares one substring and two neighbouring characters, and no pattern is
compiled. The first entry of the list wins, as ever.

An entry of which every run is frequent in names meets many of them; such joins are split by
the skew join of adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalogspark.functions.text import FREE_RIGHT_MIN_CHARS

ANCHOR = 3
LIST = "ord bigint, term string"


def term_table(spark, terms: tuple[str, ...] | list[str]) -> DataFrame:
    """A list given in Python as a table."""
    return spark.createDataFrame(list(enumerate(terms)), LIST)


def entries(terms: DataFrame) -> DataFrame:
    """(ord, term, body, anchored): each non-empty entry once, by its first place, without the end mark."""
    anchored = F.col("term").endswith("$") & (F.char_length("term") > 1)
    first = terms.filter(F.col("term") != "").groupBy("term").agg(F.min("ord").alias("ord"))
    body = F.when(anchored, F.expr("left(term, char_length(term) - 1)")).otherwise(F.col("term"))
    return first.select("ord", "term", body.alias("body"), anchored.alias("anchored"))


def runs(text: Column, n: Column | int) -> Column:
    """(place, run) of all runs of ``n`` characters, from place 1."""
    n = n if isinstance(n, Column) else F.lit(n)
    last = F.char_length(text) - n + 1
    each = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(i.alias("place"), F.substring(text, i, n).alias("run")))
    return F.when(last >= 1, each).otherwise(F.array().cast("array<struct<place:int,run:string>>"))


def anchors(listed: DataFrame, pieces: DataFrame) -> DataFrame:
    """Entries with ``run`` and ``offset``: the run that the fewest of ``pieces`` (run, ...) hold.

    A run that none holds is the best: its entry meets nothing.
    """
    own = listed.withColumn("r", F.explode(runs(F.col("body"), F.least(F.lit(ANCHOR), F.char_length("body"))))).select("ord", "term", "body", "anchored", "r.*")
    held = pieces.join(own.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "run"))
    best = own.join(held, "run", "left").groupBy("ord", "term", "body", "anchored").agg(rarest.alias("best"))
    return best.filter("best.n > 0").select("ord", "term", "body", "anchored", F.col("best.run").alias("run"), (F.col("best.place") - 1).alias("offset"))


def stands_at(lowered: Column, start: Column, body: Column, anchored: Column) -> Column:
    """Whether the entry stands at ``start`` (from 1) of a name, by the rules of its two sides."""
    word, letter = "[A-Za-z0-9_]", "[A-Za-z]"
    size = F.char_length(body)
    before = F.when(start > 1, F.substring(lowered, start - 1, F.lit(1))).otherwise(F.lit(""))
    after = F.substring(lowered, start + size, F.lit(1))
    left = ~F.substring(body, 1, 1).rlike(word) | ~before.rlike(letter)
    right = ~F.right(body, F.lit(1)).rlike(word) | F.when(anchored, ~after.rlike(word)).when(size < FREE_RIGHT_MIN_CHARS, ~after.rlike(letter)).otherwise(F.lit(True))
    return (start >= 1) & (F.substring(lowered, start, size) == body) & left & right


def first_terms(texts: DataFrame, terms: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(text, ord, term): for every distinct lowered text with an entry, the entry that comes first in the list."""
    distinct = texts.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).distinct()
    listed = entries(terms)
    lengths = [F.lit(n) for n in range(1, ANCHOR + 1)]
    # Shorter runs are cut only where the list has entries as short.
    short = listed.select(F.char_length("body").alias("n")).filter(f"n < {ANCHOR}").distinct()
    wanted = sorted({ANCHOR, *[r["n"] for r in short.collect()]})  # at most three values
    cut = distinct.select("text", F.explode(F.concat(*[runs(F.col("text"), lengths[n - 1]) for n in wanted])).alias("r")).select("text", "r.*")
    met = cut.join(anchors(listed, cut.select("run")), "run")
    found = met.filter(stands_at(F.col("text"), F.col("place") - F.col("offset"), F.col("body"), F.col("anchored")))
    return found.groupBy("text").agg(F.min(F.struct("ord", "term")).alias("first")).select("text", "first.ord", "first.term")

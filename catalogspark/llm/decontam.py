"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are lower-cased runs outside the ASCII punctuation and controls. Of every 9
consecutive 5-word hashes the smallest is kept as fingerprint (ties: the first), which
guarantees one common fingerprint at the same offset in every shared passage of 13 words.
Document fingerprints are joined with the benchmark's; a hit carries the hashes of the (at
most 9) 13-word windows around it on both sides, and extending it means comparing those,
aligned. Windows of shorter items (one window each) are looked up at every position by
their own length.

Every document also sends one row without fingerprint through the join, so one scan and
one small shuffle by document give the counts of all documents. The benchmark's
fingerprints are broadcast while they are measured to take at most BROADCAST_BYTES, and
joined by shuffle beyond. Ids of items are joined to the documents at the end, by the hash of
the item's text. A text may have up to 2^26 words (places have 26 bits).

Defined results: null and wordless texts have no words and no hits; an item without words
has no window; equal items share a window and each counts in n_items; rows repeated with
one id and text are counted alike and all returned; a null item_id is written as an empty
string in items_sha256; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, table, text_of, written

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 13, 5
SPAN = WINDOW - GRAM + 1
PLACE_BITS = 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(column: str) -> Column:
    """The words of a text as an array."""
    text = text_of(column)
    # lower() is the same as translating A-Z on pure ASCII, and much faster.
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.split(low, GAP)


def _trimmed(words: Column) -> Column:
    """Without the empty string that a gap at either end leaves."""
    head = (F.get(words, F.lit(0)) == "").cast("int")
    tail = ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    return F.slice(words, head + 1, F.size(words) - head - tail)


def _steps(last: Column) -> Column:
    """0 .. last, empty for a negative last."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    The optimizer may copy a column's expression into a lambda that runs per element; a
    lambda variable it leaves alone.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """Adds ``n`` and ``prints``, an array of (key, pos, first, ctx, len), to rows with ``text``.

    ``ctx`` holds the window hashes from window ``first`` on that cover the fingerprint.
    ``short`` lists the window lengths under 13 that are looked up at every position.
    """
    df = df.withColumn("_words", words_of("text")).withColumn("_words", _trimmed(F.col("_words"))).withColumn("n", F.size("_words"))
    n, mask = F.col("n"), (1 << PLACE_BITS) - 1

    def gram(h: Column, i: Column, k: int) -> Column:
        return F.xxhash64(*[F.get(h, i + j) for j in range(k)])

    def short_print(h: Column, k: int) -> Callable[[Column], Column]:
        # A function of the place alone: a second parameter would be given the element's index.
        def one(i: Column) -> Column:
            whole = F.xxhash64(F.lit(k), gram(h, i, k))
            return F.struct(whole.alias("key"), i.alias("pos"), i.alias("first"), F.array(whole).alias("ctx"), F.lit(k).alias("len"))

        return one

    def picked(p: Column) -> Column:
        return F.array_distinct(F.transform(_steps(n - WINDOW), lambda j: F.array_min(F.slice(p, j + 1, SPAN))))

    def long_prints(g: Column, w: Column) -> Column:
        # Hash in the high bits, place in the low bits: one minimum finds both.
        placed = F.transform(g, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint")))

        def one(m: Column) -> Column:
            pos = m.bitwiseAND(F.lit(mask)).cast("int")
            first = F.greatest(pos - (SPAN - 1), F.lit(0))
            return F.struct(
                F.shiftright(m, PLACE_BITS).alias("key"), pos.alias("pos"), first.alias("first"),
                F.slice(w, first + 1, F.least(pos, n - WINDOW) - first + 1).alias("ctx"), F.lit(WINDOW).alias("len"))

        return F.transform(let(placed, picked), one)

    def windows(g: Column) -> Column:
        return F.transform(_steps(n - WINDOW), lambda j: F.xxhash64(*[F.get(g, j + k) for k in (0, GRAM, SPAN - 1)]))

    def all_prints(h: Column) -> Column:
        grams = F.transform(_steps(n - GRAM), lambda i: gram(h, i, GRAM))
        prints = let(grams, lambda g: let(windows(g), lambda w: long_prints(g, w)))
        for k in short:
            prints = F.concat(prints, F.transform(_steps(n - k), short_print(h, k)))
        return prints

    return df.withColumn("prints", let(F.transform("_words", lambda x: F.xxhash64(x)), all_prints)).drop("_words", "text")


def benchmark_prints(benchmark: DataFrame, text_col: str) -> tuple[DataFrame, list[int]]:
    """Fingerprints of the distinct item texts, named by the text's hash, and the short lengths."""
    items = benchmark.select(F.col(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("item_text")).dropDuplicates(["item_text"])
    sizes = items.select(F.size(_trimmed(words_of("text"))).alias("n")).filter(f"n between 1 and {WINDOW - 1}").distinct()
    short = sorted(r["n"] for r in sizes.collect())  # at most 12 values
    # explode_outer: no filter on the array's size is derived and pushed below its computation.
    prints = fingerprints(items, short).withColumn("print", F.explode_outer("prints"))
    # An item shorter than 13 words is one window of its own length, no other.
    prints = prints.filter(f"print.len = least(n, {WINDOW})")
    return written(prints.select(F.col("print.key").alias("item_key"), F.col("print.pos").alias("item_pos"), F.col("print.first").alias("item_first"),
                                 F.col("print.ctx").alias("item_ctx"), F.col("print.len").alias("item_len"), "item_text")), short


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per document: id, th (hash of the text), n_words, n_hit, items (sorted ids), contaminated."""
    wanted, short = benchmark_prints(benchmark, item_text)
    wanted = bounded(wanted, F.size("item_ctx") * 8 + 64)
    # A text may be repeated in any number of items: only its hash goes through the search.
    names = benchmark.select(F.xxhash64(text_of(item_text)).alias("name_text"), F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"))
    names = bounded(names, F.octet_length("item") + 48)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"), F.col(text_col).alias("text"))
    seen = fingerprints(texts, short)
    kind = "struct<key:bigint,pos:int,first:int,ctx:array<bigint>,len:int>"
    row_itself = F.array(F.lit(None).cast(kind))
    seen = seen.withColumn("print", F.explode_outer(F.concat(row_itself, F.col("prints").cast(f"array<{kind}>")))).select("id", "th", "n", "print.*")
    joined = seen.join(wanted, (F.col("key") == F.col("item_key")) & (F.col("len") == F.col("item_len")), "left")
    joined = joined.filter("key is null or item_key is not null")
    # Windows of both sides, aligned at the fingerprint: equal hashes are occurrences.
    shift = F.col("pos") - F.col("item_pos") + F.col("item_first") - F.col("first")
    starts = F.filter(
        F.transform("ctx", lambda w, i: F.when(w == F.get("item_ctx", i - shift), F.col("first") + i)), lambda s: s.isNotNull())
    hits = joined.select("id", "th", "n", (F.col("key").isNull()).alias("itself"), "len", "item_text", F.when(F.col("key").isNotNull(), starts).alias("starts"))
    hits = hits.filter("itself or size(starts) > 0")
    spans = F.transform("starts", lambda s: F.struct(s.alias("at"), (s + F.col("len")).alias("end")))
    per = hits.groupBy("id", "th", "n").agg(
        F.sum(F.col("itself").cast("int")).alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("itself"), spans))))).alias("spans"),
        F.collect_set("item_text").alias("texts"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("hit"))
    covered = F.aggregate("spans", zero, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["end"]).alias("end"),
        (acc["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["at"]))).cast("bigint").alias("hit")), lambda acc: acc["hit"])
    per = per.withColumn("n_hit", covered).withColumn("n_words", F.col("n").cast("bigint"))
    per = per.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    # Documents without items get a key of their own, which meets nothing and spreads them.
    per = per.select("id", "th", "n_words", "n_hit", "contaminated", "copies", F.explode_outer("texts").alias("named"))
    per = per.withColumn("name_key", F.coalesce("named", F.xxhash64("id", "th")))
    per = per.join(names, (F.col("name_key") == F.col("name_text")) & F.col("named").isNotNull(), "left")
    per = per.groupBy("id", "th").agg(
        *[F.any_value(c).alias(c) for c in ("n_words", "n_hit", "contaminated", "copies")],
        F.array_sort(F.array_distinct(F.collect_list("item"))).alias("items"))
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return per.select("id", "th", "n_words", "n_hit", "items", "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    found = contamination(docs, benchmark).filter("contaminated")
    gone = written(found.select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")).distinct())
    match = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64(text_of("text")) == F.col("gone_th"))
    # Texts stay where they are while what goes is small, as measured; beyond that both sides are shuffled.
    return docs.join(bounded(gone, F.lit(32)), match, "left_anti")


def op2_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS rid FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(w) AS m, least(13, len(w)) AS k, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT rid, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, ks WHERE len(w) >= k),
dg AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM dw),
hit AS (SELECT rid, dg.k, i, item_id FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, coalesce(CAST(item_id AS VARCHAR), '') AS item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""

"""Line dedup by a deletion-neighbourhood join.

A line goes when an equal line, or one within one edit (insert, delete or replace one
character), occurs earlier in (id, line number) order; the earliest stays. Lines shorter than
``MIN_CHARS`` characters are compared exactly, as one edit is too much of them; empty lines
always stay.

1. Lines become distinct by hash with their first place (pre-aggregated). Only hashes move.
2. Two lines within one edit agree on their first or on their last half, cut by the shorter
   one's length. Lines that share neither with another distinct line are done; this
   drops no pair.
3. The rest emit their deletion neighbourhood as hashed keys, one per character of the half
   in which the edit can lie. Replaced
   characters meet in (variant, place): all lines of such a key are within one edit
   of each other. An inserted character meets as (variant) = the shorter line itself. So the
   earliest line per key, a pre-aggregated minimum, is the only partner anyone needs.
4. Edit distance is verified on the texts of those pairs.

Variant hashes come from prefix sums, so a line of n characters costs n steps however long.

Defined results: a null text has no lines; an empty text one empty line; rows repeated with one id and text
are one document and give one row; dropping is decided against all earlier lines, also
those dropped themselves; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, with_runtime_filters, written

MIN_CHARS = 24
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def deletion_hashes(line: str) -> tuple[int, np.ndarray]:
    """Hash of the line, and of the line without each of its characters."""
    codes = _mix(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + _STEP)
    n = len(codes)
    power = np.multiply.accumulate(np.full(n + 1, _STEP, np.uint64))
    ahead = np.append(np.uint64(0), np.cumsum(codes * power[:n], dtype=np.uint64))
    # Characters after the deleted one move one place down: their sum is taken over lower powers.
    behind = np.append(np.uint64(0), np.cumsum(codes[1:] * power[:n - 1], dtype=np.uint64)) if n else np.zeros(1, np.uint64)
    without = ahead[:n] + (behind[-1] - behind[:n])
    return int(_mix(ahead[n:] + np.uint64(n))[0]), _mix(without + np.uint64(max(n - 1, 0)))


def variants(lines: DataFrame) -> DataFrame:
    """(h, kind, key) for rows of (h, line, same_head, same_tail, longer, shorter_head, shorter_tail).

    ``same_*`` ask for keys that meet lines of equal length (kind 0), ``longer`` for the line
    itself as key (kind 1), ``shorter_*`` for keys that meet lines one character shorter
    (kind 2). With only the head in common the edit lies in the tail, and the other way round.
    """
    flags = ("same_head", "same_tail", "longer", "shorter_head", "shorter_tail")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                line = batch.column("line")[i].as_py()
                same_head, same_tail, longer, shorter_head, shorter_tail = (batch.column(c)[i].as_py() for c in flags)
                itself, deleted = deletion_hashes(line)
                n = len(deleted)
                keys, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)]
                if same_head or same_tail:
                    a, b = 0 if same_tail else n // 2, n if same_head else n // 2
                    keys.append(_mix(deleted[a:b] + np.arange(a, b, dtype=np.uint64) * _STEP))
                    kinds.append(np.zeros(b - a, np.int8))
                if longer:
                    keys.append(np.array([itself], np.uint64))
                    kinds.append(np.ones(1, np.int8))
                if shorter_head or shorter_tail:
                    a, b = 0 if shorter_tail else (n - 1) // 2, n if shorter_head else (n - 1) // 2 + 1
                    keys.append(np.unique(deleted[a:b]))
                    kinds.append(np.full(len(keys[-1]), 2, np.int8))
                key, kind = np.concatenate(keys).astype(np.int64), np.concatenate(kinds)
                h = np.full(len(key), batch.column("h")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(kind), pa.array(key)], names=["h", "kind", "key"])

    return lines.mapInArrow(run, "h bigint, kind tinyint, key bigint")


def line_decisions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All lines (id, th, line_no, h, chars), and the distinct ones (h, first, near).

    ``near`` says that an earlier line lies within one edit.
    """
    with_runtime_filters(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.split(text_col, "\n").alias("parts"))
    split = named.select("id", "th", F.posexplode("parts").alias("line_no", "line"))
    n = F.char_length("line")
    halves = []
    for step in (0, 1):  # as the shorter or equal line, and as the longer one
        m = n - step
        cut = F.floor(m / 2).cast("int")
        halves += [F.xxhash64(F.substring("line", F.lit(1), cut), m, F.lit("head")), F.xxhash64(F.right("line", m - cut), m, F.lit("tail"))]
    fuzzy = n >= MIN_CHARS
    rows = written(split.select(
        "id", "th", "line_no", F.xxhash64("line").alias("h"), n.alias("chars"), F.when(fuzzy, F.array(*halves)).alias("halves")))
    distinct = written(rows.filter("chars > 0").groupBy("h").agg(
        F.min(F.struct("id", "th", "line_no")).alias("first"), F.any_value("halves").alias("halves"), F.any_value("chars").alias("chars")))

    # Keys that at least two distinct lines share, by how many are shorter and longer.
    keyed = distinct.filter("halves is not null").select("h", F.posexplode("halves").alias("j", "half"))
    keyed = keyed.withColumn("long", (F.col("j") >= 2).cast("int"))
    shared = keyed.groupBy("half").agg(F.sum("long").alias("longs"), F.sum(1 - F.col("long")).alias("shorts"))
    shared = written(shared.filter("shorts > 0 and shorts + longs > 1"))
    j, more = F.col("j"), F.col("shorts") > 1
    wanted = keyed.join(shared, "half").groupBy("h").agg(
        F.max((j == 0) & more).alias("same_head"), F.max((j == 1) & more).alias("same_tail"),
        F.max((j < 2) & (F.col("longs") > 0)).alias("longer"),
        F.max(j == 2).alias("shorter_head"), F.max(j == 3).alias("shorter_tail"))
    wanted = wanted.filter("same_head or same_tail or longer or shorter_head or shorter_tail")
    wanted = written(wanted.join(distinct.select("h", "first"), "h"))

    # Texts of those lines, one scan; the documents are joined on their id, not line by line.
    asked = F.struct("h", "first", "same_head", "same_tail", "longer", "shorter_head", "shorter_tail")
    places = wanted.groupBy(F.col("first.id").alias("id"), F.col("first.th").alias("at_th")).agg(F.count(F.lit(1)).alias("lines"), F.collect_list(asked).alias("asked"))
    places = written(places).filter("lines > 0")
    found = named.join(places, "id").filter("th = at_th").select("parts", "asked")
    # Null ids are equal here; they join by text, so that the others keep their runtime filter.
    nulls = named.filter("id is null").join(places.filter("id is null").drop("id"), F.col("th") == F.col("at_th"))
    found = found.unionByName(nulls.select("parts", "asked")).select("parts", F.explode_outer("asked").alias("a")).filter("a is not null")
    texts = written(found.select("a.*", F.get("parts", F.col("a.first.line_no")).alias("line")).dropDuplicates(["h"]))

    # Keys in which lines meet are few; the rest of the variants is done.
    keys = written(variants(texts))
    met = keys.groupBy("key").agg(F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("kind").alias("k0"), F.max("kind").alias("k1"))
    met = written(met.filter("h0 <> h1 and (k0 = 0 or k0 <> k1)").select("key"))
    hits = written(keys.join(met, "key").join(wanted.select("h", "first"), "h"))
    best = F.struct("first", "h")
    same, short, long = hits.filter("kind = 0"), hits.filter("kind = 1"), hits.filter("kind = 2")
    earliest = same.groupBy("key").agg(F.min(best).alias("best"))
    pairs = same.join(earliest, "key").select("h", "first", F.col("best.first").alias("other"), F.col("best.h").alias("other_h"))
    below = short.select("key", F.col("first").alias("other"), F.col("h").alias("other_h"))
    pairs = pairs.union(long.join(below, "key").select("h", "first", "other", "other_h"))
    above = long.groupBy("key").agg(F.min(best).alias("best"))
    pairs = pairs.union(short.join(above, "key").select("h", "first", F.col("best.first"), F.col("best.h")))
    pairs = pairs.filter("other < first").select("h", "other_h").distinct()
    a = texts.select("h", F.col("line").alias("one"))
    b = texts.select(F.col("h").alias("other_h"), F.col("line").alias("two"))
    near = pairs.join(a, "h").join(b, "other_h").filter(F.levenshtein("one", "two", 1).between(0, 1)).select("h").distinct()
    near = written(near.withColumn("near", F.lit(True)))
    return rows, distinct.select("h", "first").join(near, "h", "left").withColumn("near", F.coalesce("near", F.lit(False)))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, th, n_lines, n_equal and n_near (dropped lines), kept_lines (their numbers)."""
    rows, distinct = line_decisions(docs, id_col=id_col, text_col=text_col)
    here = F.struct("id", "th", "line_no")
    lines = rows.select("id", "th", "line_no", "h", "chars").join(distinct, "h", "left")
    lines = lines.withColumn("fate", F.when(F.col("chars") == 0, 0).when(~here.eqNullSafe(F.col("first")), 1).when(F.col("near"), 2).otherwise(0))
    place = F.col("line_no")
    per = lines.groupBy("id", "th").agg(
        (F.max("line_no") + 1).cast("bigint").alias("n_lines"),
        F.size(F.collect_set(F.when(F.col("fate") == 1, place))).cast("bigint").alias("n_equal"),
        F.size(F.collect_set(F.when(F.col("fate") == 2, place))).cast("bigint").alias("n_near"),
        F.array_sort(F.collect_set(F.when(F.col("fate") == 0, place))).alias("kept_lines"))
    none = docs.filter(F.col(text_col).isNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).distinct()
    zero = F.lit(0).cast("bigint")
    return per.unionByName(none.select("id", "th", zero.alias("n_lines"), zero.alias("n_equal"), zero.alias("n_near"), F.array().cast("array<int>").alias("kept_lines")))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines cut from their texts."""
    kept = line_dedup(docs, id_col=id_col, text_col=text_col).select(F.col("id").alias("_of"), F.col("th").alias("_of_th"), F.col("kept_lines").alias("_kept"))
    joined = docs.join(kept, F.col(id_col).eqNullSafe(F.col("_of")) & (F.xxhash64(text_col) == F.col("_of_th")))
    cut = F.array_join(F.transform("_kept", lambda i: F.get(F.split(text_col, "\n"), i)), "\n")
    return joined.select(*[F.when(F.col(text_col).isNotNull(), cut).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op8_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        F.col("id").alias("doc_id"), "n_lines", "n_equal", "n_near", F.md5(F.array_join("kept_lines", ",")).alias("kept_md5"))


OP8_SQL = r"""
WITH rows AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
firsts AS (SELECT line, min((doc_id, line_no)) AS first, length(line) AS n FROM rows WHERE line <> '' GROUP BY line),
pairs AS (
  SELECT a.line, a.first, b.line AS other, b.first AS other_first FROM firsts a JOIN firsts b ON a.n = b.n WHERE a.n >= 24
  UNION ALL SELECT a.line, a.first, b.line, b.first FROM firsts a JOIN firsts b ON a.n = b.n + 1 WHERE b.n >= 24
  UNION ALL SELECT a.line, a.first, b.line, b.first FROM firsts a JOIN firsts b ON a.n = b.n - 1 WHERE a.n >= 24),
near AS (SELECT DISTINCT line FROM pairs WHERE other_first < first
  AND (substr(line, 1, length(line) // 2 - 1) = substr(other, 1, length(line) // 2 - 1) OR right(line, length(line) // 2 - 1) = right(other, length(line) // 2 - 1))
  AND levenshtein(line, other) <= 1),
f AS (SELECT r.doc_id, r.line_no, CASE WHEN r.line = '' THEN 0 WHEN (r.doc_id, r.line_no) <> f.first THEN 1 WHEN n.line IS NOT NULL THEN 2 ELSE 0 END AS fate
  FROM rows r LEFT JOIN firsts f ON r.line = f.line LEFT JOIN near n ON r.line = n.line)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (fate = 1) AS BIGINT) AS n_equal, CAST(count(*) FILTER (fate = 2) AS BIGINT) AS n_near,
  md5(coalesce(string_agg(line_no, ',' ORDER BY line_no) FILTER (fate = 0), '')) AS kept_md5
FROM f GROUP BY doc_id
"""

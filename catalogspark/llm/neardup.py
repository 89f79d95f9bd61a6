"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidates.

Documents are linked when their sets of distinct 5-word shingles share at least 75 % of
their union. Steps, all distributed:

1. One pass over the texts gives set size, a 128-bit key of the set and the band hashes
   of a one-permutation signature with optimal densification (128 bins, 32 bands of 4).
   Two sets at the threshold share a band with probability 0.999995.
2. Documents with equal sets become one class (pre-aggregated), so a group of copies
   costs one row from here on.
3. Classes meet in buckets. A bucket emits a star: its hub, the member that meets most
   others over all buckets, against each other member. Pairs whose signatures agree
   enough are confirmed on the full sets, and components are formed. Buckets that then still hold several components are
   *open*. They emit stars once more with a hub drawn by hash. What is open after that is joined exactly, on the
   rarest shingles of full sets (``finished``). Every star is linear in its bucket.
4. Components take the smallest id by min-label propagation with pointer jumping.

No bucket, class or component is collected in one task: minima and hubs are aggregates with
map-side combine, and bucket joins are split by the skew join of adaptive execution.

Defined results: a null or blank text has an empty set, is linked with nothing and is
kept; a null id takes no part in links (component null, kept true); rows repeated with one
id and text are the same document and share their result; one id with several texts is one
document that is linked through any of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, table, with_runtime_filters, written
from .shingles import PLANES, OnePermutation, _TURN, mixed, shingle_sets

SIMILAR = (75, 100)
NOTHING = np.zeros(0, np.int64)
#: Share of equal bins (four bits each) of two sets at the threshold, and the deviations
#: below it at which a pair is not compared any more.
AGREE, DEVIATIONS = 0.75 + 0.25 / 16, 5
#: Slots of the frequency table that orders the shingles of what is open (any order is exact).
SLOTS = 1 << 20


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    a = int(np.sum(shingles * _TURN[40], dtype=np.uint64)) ^ len(shingles)
    b = int(np.sum(mixed(shingles ^ _TURN[41]), dtype=np.uint64))
    return int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """A list column of 64-bit numbers."""
    lengths = np.append(0, np.cumsum([len(a) for a in arrays]))
    return pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate([NOTHING, *arrays])))


def signatures(texts: DataFrame, width: int = 5) -> DataFrame:
    """``n_shingles``, set key ``h1, h2``, ``bands`` and ``planes`` for rows of (id, th, text)."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = OnePermutation()
        for batch in batches:
            n, h1, h2, bands, planes = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), width):
                n.append(len(s))
                a, b = _set_key(s)
                h1.append(a)
                h2.append(b)
                signature = minhash.signature(s) if len(s) else None
                bands.append(minhash.bands(signature).astype(np.int64) if len(s) else NOTHING)
                planes.append(minhash.planes(signature) if len(s) else NOTHING)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists(bands), lists(planes)],
                names=["id", "th", "n_shingles", "h1", "h2", "bands", "planes"])

    return texts.mapInArrow(run, f"id {id_type}, th bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>, planes array<bigint>")


def full_sets(texts: DataFrame, width: int = 5) -> DataFrame:
    """The whole shingle set for rows of (cls, h1, text); rows whose set key differs are dropped."""
    id_type = texts.schema["cls"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, keep, sets = batch.column("h1").to_pylist(), [], []
            for i, s in enumerate(shingle_sets(batch.column("text"), width)):
                if _set_key(s)[0] == keys[i]:
                    keep.append(i)
                    sets.append(s.astype(np.int64))
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("cls").take(rows), batch.column("h1").take(rows), lists(sets)], names=["cls", "h1", "shingles"])

    return texts.mapInArrow(run, f"cls {id_type}, h1 bigint, shingles array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """(v, comp) for every end of ``links`` (a, b): the smallest id that can be reached."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = written(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("c"))
        lower = labels.join(near, "v").select("v", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("v").alias("comp"), F.col("comp").alias("far"))
        lower = written(lower.join(jump, "comp", "left").select("v", "was", F.least("comp", F.coalesce("far", "comp")).alias("comp")))
        labels = lower.select("v", "comp")
        if lower.filter("comp <> was").isEmpty():
            return labels


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return pairs.join(one, "a").join(two, "b").filter(both * SIMILAR[1] >= union * SIMILAR[0]).select("a", "b")


def may_agree() -> Column:
    """Whether the signatures of a pair (planes, other) leave a chance of similar sets."""
    words = 128 // 64
    differ = []
    for w in range(words):
        bits = None
        for p in range(PLANES):
            x = F.get("planes", F.lit(p * words + w)).bitwiseXOR(F.get("other", F.lit(p * words + w)))
            bits = x if bits is None else bits.bitwiseOR(x)
        differ.append(F.bit_count(bits))
    # A small set fills few bins, and agreement then rests on as many draws only.
    filled = 128 * (1 - F.exp(-F.least("n", "nb") / F.lit(128.0)))
    slack = DEVIATIONS * 128 * F.sqrt(F.lit(AGREE * (1 - AGREE)) / filled)
    return 128 - (differ[0] + differ[1]) >= 128 * AGREE - slack


def agreeing(pairs: DataFrame, planes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures leave a chance; ``planes`` has cls, n, planes."""
    one = planes.select(F.col("cls").alias("a"), "n", "planes")
    two = planes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("planes").alias("other"))
    return pairs.join(one, "a").join(two, "b").filter(may_agree()).select("a", "b")


def stars(members: DataFrame, order: Column, planes: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links between each bucket's hub, the largest by ``order``, and its other members.

    ``members`` has bucket, cls, n, comp; members of the hub's own component are not tested.
    """
    hub = F.struct(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    hubs = members.groupBy("bucket").agg(F.max_by(hub, order).alias("hub")).select("bucket", "hub.*")
    pairs = members.join(hubs, "bucket").filter(
        (F.col("comp") != F.col("cb")) & (F.least("n", "nb") * SIMILAR[1] >= F.greatest("n", "nb") * SIMILAR[0]))
    return confirmed(agreeing(pairs.select(F.col("cls").alias("a"), "b").distinct(), planes), sets)


def frequencies(sets: DataFrame) -> np.ndarray:
    """In how many sets the shingles of each of ``SLOTS`` hash slots occur: a bounded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            values = batch.column("shingles").flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(values & (SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    counted = sets.select("shingles").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    return out


def rarest(sets: DataFrame, frequency: np.ndarray) -> DataFrame:
    """Rows (shingle, cls, comp, n, most) of the prefixes of (cls, comp, shingles), rarest shingles first.

    Two sets of n and m shingles are similar when they have (n + m) * 3 / 7 in common. So, if the
    first one they share stands at place i of the set of n, the other set has at most ``most`` =
    (n - i) * 7 / 3 - n shingles. The prefix ends where no similar set is that small.
    """
    id_type = sets.schema["cls"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, most, n = [], [], []
            for row in batch.column("shingles"):
                s = row.values.to_numpy(zero_copy_only=False)
                limit = (len(s) * SIMILAR[1] - np.arange(len(s)) * sum(SIMILAR)) // SIMILAR[0]
                limit = limit[limit * SIMILAR[1] >= len(s) * SIMILAR[0]]
                parts.append(s[np.lexsort((s, frequency[s & (SLOTS - 1)]))[:len(limit)]])
                most.append(limit)
                n.append(len(s))
            of = np.repeat(np.arange(len(n)), [len(p) for p in parts])
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([NOTHING, *parts])), batch.column("cls").take(take), batch.column("comp").take(take),
                 pa.array(np.array(n, np.int64)[of]), pa.array(np.concatenate([NOTHING, *most]))], names=["shingle", "cls", "comp", "n", "most"])

    return sets.mapInArrow(run, f"shingle bigint, cls {id_type}, comp {id_type}, n bigint, most bigint")


def finished(left: DataFrame, planes: DataFrame, sets: DataFrame) -> DataFrame:
    """All links between classes of different components among ``left`` (cls, comp).

    Classes meet at shared prefix shingles (``rarest``). Of a similar pair the smaller set has
    the shingle at a place where ``most`` reaches its own size: it is *strong* there. A
    shingle that many texts share, but that is among the rarest seventh of none, is strong in
    none and makes no pair at all, so crowds that share a passage short of the threshold
    cost their prefixes only. Sizes within 3 : 4 meet by class of size.
    """
    ends = sets.join(left.select("cls", "comp").distinct(), "cls").select("cls", "comp", "shingles")
    ends = written(ends)
    rare = rarest(ends, frequencies(ends)).withColumn("strong", F.col("most") >= F.col("n"))
    met = rare.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("strong").alias("strongest")).filter("lo <> hi and strongest").select("shingle")
    rare = written(rare.join(met, "shingle"))
    size_class = F.floor(F.log("n") / np.log(SIMILAR[1] / SIMILAR[0])).cast("int")
    small = rare.filter("strong").select("shingle", size_class.alias("class"), F.col("cls").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("most").alias("ma"))
    large = rare.withColumn("class", F.explode(F.array(size_class - 1, size_class)))
    large = large.select("shingle", "class", F.col("cls").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("most").alias("mb"))
    pairs = small.join(large, ["shingle", "class"]).filter("ca <> cb and nb >= na and nb <= ma and na <= mb and (nb > na or a < b)")
    return confirmed(agreeing(pairs.select("a", "b").distinct(), planes), sets)


def one_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of an id that has several texts."""
    several = rows.filter("n_shingles > 0 and id is not null").groupBy("id").agg(
        F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).filter("lo <> hi").select("id")
    own = rows.join(several, "id").join(classes.select("h1", "h2", "n_shingles", "cls"), ["h1", "h2", "n_shingles"]).select("id", "cls").distinct()
    first = own.groupBy("id").agg(F.min("cls").alias("b"))
    return own.join(first, "id").filter("cls <> b").select(F.col("cls").alias("a"), "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """Per row of ``docs``: id, th (hash of the text), n_shingles, component_id, kept."""
    with_runtime_filters(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    rows = written(signatures(texts, width))

    classes = rows.filter("n_shingles > 0 and id is not null").groupBy("h1", "h2", "n_shingles")
    classes = written(classes.agg(F.min("id").alias("cls"), F.any_value("bands").alias("bands"), F.any_value("planes").alias("planes")))
    buckets = classes.select("cls", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    met = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(buckets.join(met, "bucket"))
    degree = written(members.groupBy("cls").agg(F.sum("size").alias("degree")))
    planes = written(degree.select("cls").join(classes.select("cls", F.col("n_shingles").alias("n"), "h1", "planes"), "cls"))
    sets = texts.select(F.col("id").alias("cls"), "text").join(planes.select("cls", "h1"), "cls").select("cls", "h1", "text")
    sets = written(full_sets(sets, width).dropDuplicates(["cls", "h1"])).select("cls", "shingles")

    # Members that meet most others come first; they hold their group together.
    most = members.select("bucket", "cls", "n", F.col("cls").alias("comp")).join(degree, "cls")
    links = written(stars(most, F.struct("degree", F.xxhash64("cls")), planes, sets).unionByName(one_id(rows, classes)))
    comps = components(links)
    # A star tests one hub of each bucket. Once more with another, then all pairs that are left.
    for turn in range(2):
        placed = members.select("bucket", "cls", "n").join(comps.withColumnRenamed("v", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        opened = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
        left = written(placed.join(opened, "bucket"))
        if turn == 0:
            found = stars(left, F.xxhash64("cls", "bucket"), planes, sets)
        else:
            found = finished(left, planes, sets)
        found = written(found)
        if not found.isEmpty():
            links = links.unionByName(found)
            comps = components(links)

    named = classes.select("h1", "h2", "n_shingles", "cls").join(comps.withColumnRenamed("v", "cls"), "cls", "left")
    named = named.select("h1", "h2", "n_shingles", F.coalesce("comp", "cls").alias("comp"))
    found = rows.join(written(named), ["h1", "h2", "n_shingles"], "left").select(
        "id", "th", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents of which ``kept`` holds, one of each group, with their columns."""
    gone = written(near_duplicates(docs).filter("not kept").select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")).distinct())
    match = (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("gone_th"))
    # Texts stay where they are while what goes is small, as measured; beyond that both sides are shuffled.
    return docs.join(bounded(gone, F.lit(32)), match, "left_anti")


def op3_near_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")

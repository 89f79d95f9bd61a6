"""Mixing and sharding: laws that must hold, and equality with SQL."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from catalogspark.llm import mixing, queries, shards
from catalogspark.llm.queries import ORACLES
from catalogspark.plans.compare import connect, differences

from .fixtures import documents, words


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert differences(df.columns, df.collect(), connect(sf), ORACLES[name]) == []


@pytest.fixture(scope="module")
def uneven(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.choice([1, 30, 60, 400]))), rng.choice(["a", "a", "a", "b", "c", None, "d"])) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", "b"), (5002, "one two", "z"), (5003, "one two", "z"), (None, "three words here", "a"), (7, "again", "b")]
    return documents(spark, rows).withColumn("size", F.lit("clash")).withColumn("row", F.lit(1))


def test_mix_reaches_targets(uneven):
    got = mixing.mix(uneven).select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "copies").collect()
    assert len(got) == uneven.count()
    total = sum(len((r.text or "").split()) for r in got)
    by = defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").split()) and 0 <= r.copies <= 2
        by[r.source].append(r)
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(1.5 * total)
    for source, rs in by.items():
        size = sum(r.size for r in rs)
        assert {r.source_size for r in rs} == {size}
        assert rs[0].target <= 2 * size + 1e-6
        taken = sum(r.copies * r.size for r in rs)
        assert abs(taken - rs[0].target) <= max(r.size for r in rs) / 2 + 1e-6
    again = mixing.mix(uneven).select("row.doc_id", "row.text", "copies").collect()
    assert Counter(map(tuple, again)) == Counter((r.doc_id, r.text, r.copies) for r in got)


def test_repeated_returns_the_columns(uneven):
    mixed = mixing.mix(uneven)
    out = mixing.repeated(mixed)
    assert out.columns == uneven.columns
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]


def test_mix_of_one_source_and_of_nothing(spark):
    one = mixing.mix(documents(spark, [(1, "a b c", "s"), (2, "d e f", "s")])).collect()
    assert {r.target for r in one} == {9.0} and sum(r.copies * r.size for r in one) == 9
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [r.copies for r in mixing.mix(documents(spark, [(1, None)])).collect()] == [0]


def test_shards_are_even_gapless_and_keep_copies(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, rng.choice([5, 50, 200]))), f"s{rng.randrange(5)}") for i in range(3000)]
    rows += [(10_000 + i, "the very same text " * 3, f"s{i % 3}") for i in range(40)]
    rows += [(20_000, None), (20_001, ""), (None, "no id"), (3, "twice"), (3, "twice")]
    docs = documents(spark, rows).withColumn("shard", F.lit("clash")).withColumn("size", F.lit(1.5))
    placed = shards.shard(docs, 16)
    assert placed.select("row.*").columns == docs.columns
    got = placed.select("row.doc_id", "row.text", "shard", "slot").collect()
    assert len(got) == len(rows)
    slim = shards.assign(docs, 16).collect()
    assert sorted((str(r.id), r.shard, r.slot) for r in slim) == sorted((str(r.doc_id), r.shard, r.slot) for r in got)
    assert sorted((str(r.id), r.size, r.text_crc32) for r in slim) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    loads, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        loads[r.shard] += len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
        homes[r.text].add(r.shard)
    assert sorted(loads) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(loads.values()) / 16
    assert max(abs(v - mean) for v in loads.values()) < 0.05 * mean
    assert all(len(s) == 1 for s in homes.values())


def test_a_group_of_copies_larger_than_a_shard_is_cut(spark):
    rows = [(i, "copied text of some length " * 4) for i in range(900)] + [(1000 + i, f"other text {i} " * 8) for i in range(1800)]
    got = shards.assign(documents(spark, rows), 8).select("size", "shard").collect()
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    mean = sum(loads.values()) / 8
    assert len(loads) == 8 and max(abs(v - mean) for v in loads.values()) < 0.15 * mean


def test_shards_of_little(spark):
    assert shards.shard(documents(spark, []), 16).count() == 0
    one = shards.shard(documents(spark, [(1, "x")]), 16).collect()
    assert len(one) == 1 and one[0].slot == 0 and 0 <= one[0].shard < 16

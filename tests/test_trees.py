"""A table of boolean trees equals one search per tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_grams import WORDS, random_tree

from catalogspark.operators import index, search, trees


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        name = rng.choice([" ", "_"]).join(rng.choice(WORDS) for _ in range(rng.randrange(5))) + rng.choice([".mkv", ".pdf", "", "."])
        rows.append((f"f{i:04d}", name, rng.choice([0, 1, 499, 500, 501, 1023, 1024, 2 ** 40])))
    files = spark.createDataFrame(rows, "file_hash string, name string, size bigint").cache()
    return files, index.postings(files).cache(), trees.search_keys(files).cache()


def as_table(spark, asked):
    """(query_id, nodes) of a list of trees."""
    arrays = F.array(*[F.struct(F.lit(i).alias("query_id"), trees.postfix(t).alias("nodes")) for i, t in enumerate(asked)])
    return spark.range(1).select(F.explode(arrays).alias("q")).select("q.*")


FIXED = [
    {"term": "*"}, {"term": ""}, {"term": "gear red"}, {"term": "the"}, {"num": "size", "op": "=", "value": 500}, {"num": "size", "op": "!=", "value": 500},
    {"num": "size", "op": "<", "value": 500}, {"num": "size", "op": ">=", "value": 1024}, {"num": "size", "op": ">", "value": -1}, {"num": "size", "op": "<=", "value": -5},
    {"not": [{"term": "red"}, {"term": "gear"}]}, {"or": [{"term": "gear"}, {"type": "unheard"}]},
    {"not": [{"not": [{"term": "red"}, {"term": "gear"}]}, {"or": [{"term": "rod"}, {"format": "pdf"}]}]},
]


def test_equals_one_search_per_tree(spark, catalog):
    files, postings, keys = catalog
    rng = random.Random(7)
    asked = FIXED + [random_tree(rng) for _ in range(22)]
    got = {}
    for r in sorted(trees.batch_trees(files, keys, as_table(spark, asked), cap=10_000).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.file_hash)
    for i, tree in enumerate(asked):
        want = [r.file_hash for r in search.search(files, postings, None, tree, cap=10_000).collect()]
        assert got.get(i, []) == want, tree


def test_cap_equal_trees_and_empty_ones(spark, catalog):
    files, _, keys = catalog
    asked = as_table(spark, [{"term": "red"}, {"term": "red"}, {"term": "blue"}])
    empty = spark.createDataFrame([(7, None), (8, [])], f"query_id int, nodes array<struct<{trees.NODE.replace(' ', ':').replace(',:', ',')}>>")
    gone = files.filter(F.lower("name").contains("gear")).select("file_hash")
    got = trees.batch_trees(files, keys, asked.unionByName(empty), withheld=gone, cap=3).collect()
    by_query = {q: sorted((r.rank, r.file_hash) for r in got if r.query_id == q) for q in (0, 1, 2, 7, 8)}
    assert by_query[0] == by_query[1] and len(by_query[0]) == 3 and not by_query[7] and not by_query[8]
    assert not any("gear" in r.name.lower() for r in got)


def test_words_and_name_may_answer_by_different_sides(spark):
    """The name holds one side's word inside another word, and has the whole word of the other side only."""
    rows = [("f1", "cold gear.exe", 1), ("f2", "old gear.mp3", 1)] + [(f"g{i}", "gear x.pdf", 1) for i in range(9)]
    files = spark.createDataFrame(rows, "file_hash string, name string, size bigint")
    tree = {"or": [{"term": "old"}, {"and": [{"term": "gear"}, {"type": "audio"}]}]}
    want = [r.file_hash for r in search.search(files, index.postings(files), None, tree).collect()]
    got = trees.batch_trees(files, trees.search_keys(files), as_table(spark, [tree])).collect()
    assert sorted(r.file_hash for r in got) == want == ["f1", "f2"]


def test_covers_are_cheap(spark):
    """The rarer side of a conjunction, both of a disjunction, the left of an exclusion."""
    tree = {"not": [{"or": [{"and": [{"term": "common"}, {"term": "rare"}]}, {"and": [{"type": "iso"}, {"term": "middle"}]}]}, {"term": "rarest"}]}
    grams = {f"g:{w[i:i + 3]}": 1000 for w in ("common", "rare", "middle") for i in range(len(w) - 2)}
    counts = {"t:common": 900, "t:rare": 2, "t:middle": 50, "t:rarest": 1, "x:iso": 80, "x:bin": 20, "s:20": 5000} | grams
    row = spark.range(1).select(
        F.transform(trees.postfix(tree), trees._leaf).alias("nodes"), F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]).cast("map<string,bigint>").alias("counts"))
    assert sorted(row.select(trees.cover(F.col("nodes"), F.col("counts")).alias("c")).first().c) == ["t:middle", "t:rare"]


def test_long_covers_are_read_by_prefix(spark, monkeypatch):
    """All files answer the first tree, few the second: both are whole, and the first reads a prefix."""
    rows = [(hashlib.md5(str(i).encode()).hexdigest(), f"word{i % 500} common.mp3", i) for i in range(4000)]
    files = spark.createDataFrame(rows, "file_hash string, name string, size bigint")
    asked = as_table(spark, [{"not": [{"num": "size", "op": ">=", "value": 0}, {"term": "word7777"}]}, {"meta": "word499"}, {"format": "mp3"}])
    widths = []
    real = trees.cut_lineage
    monkeypatch.setattr(trees, "FIRST_ROWS", 2)
    monkeypatch.setattr(trees, "cut_lineage", lambda df: widths.append(real(df)) or widths[-1])
    got = trees.batch_trees(files, trees.search_keys(files), asked, cap=5).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append(r.file_hash)
    every = sorted(r[0] for r in rows)
    rare = sorted(r[0] for r in rows if "word499" in r[1])
    assert sorted(by_query.values()) == sorted([every[:5], rare[:5], every[:5]])
    assert len(widths) > 1 and widths[0].filter("start < 4").count() > 0


def test_pairs_move_once_and_sources_once(spark, catalog, monkeypatch):
    """Pairs of tree and file carry a number, move to their file alone, and files with a source are looked up once."""
    files, _, keys = catalog
    sources = files.select("file_hash", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("user")).filter("user < 12345")
    made = []
    real = trees.cut_lineage
    monkeypatch.setattr(trees, "FIRST_ROWS", 0.001)
    monkeypatch.setattr(trees, "cut_lineage", lambda df: made.append(df) or real(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = trees.batch_trees(files, keys, as_table(spark, [{"term": "red"}, {"meta": "gea"}]), source_rows=sources, cap=3)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in [*made, got]]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for plan in plans for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("tree#" in line and "file_hash#" in line for line in moved)
    assert sum("12345" in plan for plan in plans) == 1
    assert len(got.collect()) == 6


def test_covers_may_be_too_many_to_go_to_the_index(spark, catalog, monkeypatch):
    files, postings, keys = catalog
    monkeypatch.setattr(trees, "FEW_COVERS", 0)
    got = trees.batch_trees(files, keys, as_table(spark, FIXED), cap=10_000).collect()
    for i, tree in enumerate(FIXED):
        want = [r.file_hash for r in search.search(files, postings, None, tree, cap=10_000).collect()]
        assert [r.file_hash for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] == want

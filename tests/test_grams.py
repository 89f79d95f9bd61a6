"""Search by n-grams equals the scan, and tests only the names of candidates."""

import random

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import grams, search

WORDS = ["Red", "blue", "gear", "rod", "anvil", "x", "ab", "été", "語語", "a-b"]


def random_tree(rng, depth=0):
    kind = rng.choice(["and", "or", "not", "term", "meta", "format", "type", "num"] if depth < 3 else ["term", "meta"])
    if kind in ("and", "or", "not"):
        return {kind: [random_tree(rng, depth + 1), random_tree(rng, depth + 1)]}
    piece = lambda: (lambda w: w[rng.randrange(len(w)):])(rng.choice(WORDS))
    return {
        "term": lambda: {"term": rng.choice([piece(), f"{piece()} {piece()}", "*", ""])}, "meta": lambda: {"meta": piece()},
        "format": lambda: {"format": rng.choice(["mkv", "PDF", "x"])}, "type": lambda: {"type": rng.choice(["video", "doc", "unheard"])},
        "num": lambda: {"num": rng.choice(["size", "bitrate"]), "op": rng.choice([">", "<=", "!="]), "value": 500},
    }[kind]()


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(2)
    rows = []
    for i in range(800):
        name = rng.choice([" ", "_", ""]).join(rng.choice(WORDS) for _ in range(rng.randrange(4))) + rng.choice([".mkv", ".pdf", "", ".x.", "mkv"])
        rows.append((f"f{i:04d}", name, rng.randrange(1000)))
    files = spark.createDataFrame(rows, "file_hash string, name string, size bigint").cache()
    return files, grams.gram_postings(files).cache()


def answers(files, tree, gram_rows):
    found = search.search(files, None, None, tree, match="substring", gram_rows=gram_rows, cap=10_000)
    return [r.file_hash for r in found.collect()]


def test_equals_scan_on_random_trees(catalog):
    files, gram_rows = catalog
    rng = random.Random(3)
    narrowed = 0
    for _ in range(25):
        tree = random_tree(rng)
        narrowed += grams.needed(tree) is not None
        assert answers(files, tree, gram_rows) == answers(files, tree, None), tree
    assert narrowed > 8


def test_names_are_tested_after_the_join(catalog):
    files, gram_rows = catalog
    plan = search.search(files, None, None, {"term": "nvi ear"}, match="substring", gram_rows=gram_rows)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    tested = [i for i, line in enumerate(lines) if "contains(" in line.lower() and "name" in line]
    joined = [i for i, line in enumerate(lines) if "Join" in line]
    assert tested and joined and max(tested) <= min(joined)  # in the join or nearer to the root


def test_rarest_gram_is_read():
    counts = {"ear": 900, "gea": 3, "red": 50, ".mkv": 1, ".mk": 40, "mkv": 60}
    wanted, n = grams.condition(grams.needed({"and": [{"term": "gear"}, {"term": "red"}]}), counts)
    assert wanted == ("and", [("gram", "gea")]) and n == 3  # the list of "red" is not worth reading
    wanted, _ = grams.condition(grams.needed({"or": [{"term": "gear"}, {"format": "mkv"}]}), counts)
    assert wanted == ("or", [("gram", "gea"), ("gram", "mkv")])
    assert grams.needed({"or": [{"term": "gear"}, {"term": "x"}]}) is None
    assert grams.needed({"not": [{"num": "size", "op": ">", "value": 1}, {"term": "gear"}]}) is None


def test_grams_of_short_and_odd_names(spark):
    rows = spark.createDataFrame([("a", None), ("b", ""), ("c", "x"), ("d", "Ab"), ("e", "語語語語")], "file_hash string, name string")
    got = {(r.file_hash, r.gram) for r in grams.gram_postings(rows).collect()}
    assert got == {("d", "ab"), ("e", "語語"), ("e", "語語語")}
    assert grams.gram_postings(rows).count() == 3


def test_bucketed_table_gives_the_same(spark, catalog):
    files, gram_rows = catalog
    spark.sql("DROP TABLE IF EXISTS gram_table")
    grams.write_gram_postings(gram_rows, "gram_table", buckets=16)
    tree = {"or": [{"term": "nvi red"}, {"type": "video"}]}
    assert answers(files, tree, spark.table("gram_table")) == answers(files, tree, gram_rows)
    spark.sql("DROP TABLE gram_table")

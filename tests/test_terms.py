"""Term tables against the list in the plan, and list changes against a full re-screen."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from catalogspark.functions import text
from catalogspark.operators import screen, terms
from catalogspark.operators.screen import Policy, Rule, Words
from catalogspark.sources import policy_store

PIECES = ["red", "rod", "gear", "a", "ring", "x1", "été", "語", "_", "-", " ", ".", "R", "$", "anvils", "7"]


def mangled(name):
    return name.encode().decode("latin-1")


@pytest.fixture(scope="module")
def names():
    rng = random.Random(4)
    plain = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(7))) for _ in range(400)]
    return plain + [mangled(n + "é gear") for n in plain[:40]] + [mangled(mangled(n + "é")) for n in plain[40:60]]


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(5)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.choice([1, 1, 2, 3]))).lower() + rng.choice(["", "", "$"]) for _ in range(60)]
    return [t for t in made if t.strip() and t != "$"] + ["", "$", "a", "é", "rin", "ring", "ring"]


def test_equals_the_list_in_the_plan(spark, names, lists):
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("text", F.lower("name"))
    want = {r.text: r.term for r in df.select("text", text.first_matching_term(F.col("text"), lists).alias("term")).collect() if r.term is not None}
    got = {r.text: r.term for r in terms.first_terms(df, terms.term_table(spark, lists)).collect()}
    assert got == want and len(got) > 100


def test_long_list_keeps_the_first_entry(spark):
    """A hundred thousand entries; the list order decides, not the place in the name."""
    listed = spark.range(100_000).select(F.col("id").alias("ord"), F.concat(F.lit("entry"), (99_999 - F.col("id")).cast("string"), F.lit("$")).alias("term"))
    found = terms.first_terms(spark.createDataFrame([("entry5 entry77777 x",), ("entry123456",), ("an entry 5",), (None,)], "text string"), listed).collect()
    assert [(r.text, r.term, r.ord) for r in found] == [("entry5 entry77777 x", "entry77777$", 22_222)]
    assert terms.first_terms(spark.createDataFrame([], "text string"), listed).count() == 0
    assert terms.first_terms(spark.createDataFrame([("a",)], "text string"), listed.limit(0)).count() == 0


RULE = Rule(evidence=Words(prefix=("gear",)), context=Words(substring=("x1",)))


def verdicts(df):
    return {r.file_hash: (r.layer, r.reason) for r in df.collect()}


@pytest.fixture(scope="module")
def files(spark, names):
    return spark.createDataFrame([(f"f{i}", n) for i, n in enumerate(names)], "file_hash string, name string").cache()


def test_screening_with_tables(spark, files, lists):
    hashes = spark.createDataFrame([("f1", "ban"), ("f2", "allow"), ("f3", "poison")], "file_hash string, list string")
    short = Policy(hashes=hashes, terms=tuple(lists[:20]), extra_terms=("anvil", "été"), rule=RULE)
    long_ = replace(short, terms=terms.term_table(spark, short.terms), extra_terms=terms.term_table(spark, short.extra_terms))
    want = verdicts(screen.screen(files, short))
    assert verdicts(screen.screen(files, long_)) == want
    assert verdicts(screen.screen(files, replace(short, terms=long_.terms))) == want
    assert any(reason and reason.endswith(screen.MOJIBAKE) for _, reason in want.values())


@pytest.mark.parametrize("seed", [1, 3])
def test_list_changes_equal_a_full_rescreen(spark, files, lists, seed):
    rng = random.Random(seed)
    rows = [(f"f{rng.randrange(460)}", rng.choice(["allow", "ban", "poison"])) for _ in range(40)]
    table = lambda r: spark.createDataFrame(r, "file_hash string, list string")
    before = Policy(hashes=table(rows[:30]), terms=tuple(rng.sample(lists, 25)), extra_terms=("anvil", "été"), rule=RULE)
    moved = list(before.terms[3:]) + rng.sample(lists, 4)
    if seed % 2:
        rng.shuffle(moved)
    after = replace(before, hashes=table(rows[10:]), terms=tuple(moved), extra_terms=("été", "anvil", "x1$") if seed > 1 else before.extra_terms)
    if seed == 3:
        after = replace(after, terms=terms.term_table(spark, after.terms))
    screened = screen.screen(files, before).cache()
    want = sorted(tuple(r) for r in screen.rescreen(screened, after).collect())
    for runs in (None, screen.name_runs(files)):
        assert sorted(tuple(r) for r in screen.rescreen_changes(screened, before, after, runs).collect()) == want
    assert len(want) > 10


def test_nothing_and_the_rule_changed(spark, files):
    before = Policy(terms=("red",), rule=RULE)
    screened = screen.screen(files, before)
    assert screen.rescreen_changes(screened, before, before).count() == 0
    after = replace(before, rule=Rule(evidence=Words(prefix=("rod",)), context=Words(substring=("x1",))))
    assert screen.rescreen_changes(screened, before, after).count() == screen.rescreen(screened, after).count() > 0


def test_store_keeps_long_lists_as_tables(spark, tmp_path, files):
    root, hashes = str(tmp_path / "p"), spark.createDataFrame([("f1", "ban")], "file_hash string, list string")
    many = terms.term_table(spark, [f"entry{i}" for i in range(policy_store.INLINE_TERMS)] + ["gear", "red"])
    policy_store.publish(spark, root, 1, hashes=hashes, terms=many, extra_terms=("rod",))
    policy = policy_store.load(spark, root)
    assert policy.terms.count() == policy_store.INLINE_TERMS + 2 and policy.extra_terms == ("rod",)
    assert verdicts(screen.screen(files, policy)) == verdicts(screen.screen(files, Policy(hashes=hashes, terms=("gear", "red"), extra_terms=("rod",))))


def test_term_table_sql_settles_ties():
    """Two entries of one part have one place in the list; the smaller one is the answer."""
    import __spark_entry__ as contract

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("""CREATE TABLE part AS SELECT * FROM (VALUES (70, 'zed anvil', 'T', 'Brand#1', 3), (140, 'aaa bolt', 'T', 'Brand#1', 3))
        t(p_partkey, p_name, p_type, p_brand, p_size)""")
    con.execute("""CREATE TABLE lineitem AS SELECT k AS l_orderkey, k AS l_partkey, 1 AS l_suppkey, 4 AS l_linenumber, 'N' AS l_returnflag,
        TIMESTAMP '2000-01-01' AS l_shipdate FROM (VALUES (70), (140)) t(k)""")
    assert sorted(con.execute(contract.oracle_sql()["e2_term_table"]).fetchall()) == [
        ("aaa bolt.pdf", "aaa bolt."), ("zed anvil.bin", "anvil")]

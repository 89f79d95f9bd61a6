"""The prefix trie against a trie built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from catalogspark.llm import trie

TURNS = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    """conv -> list of (role, text), by the contract."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    out = []
    for key, who in members.items():
        below = [k for k in members if k[:len(key)] == key]
        ends = sorted(c for c in who if len(convs[c]) == len(key))
        out.append((
            min(who), len(key), min(members[key[:-1]]) if key else None, len(who), len(kids[key]), sum(not kids[k] for k in below),
            sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(5)
    rows = []
    for c in [*range(-3, 60), 100, 101, 102, 250, 299]:
        kind = rng.randrange(4)
        n = rng.choice([1, 2, 3, 5, 9, 14])
        for t in range(n):
            word = "hot" if kind == 0 else rng.choice(["a", "bb", "Größe", ""])
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", word))
    # Ties, null numbers, null roles and texts, repeated rows, a null id, one long conversation.
    rows += [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (8, None, None, None), (8, None, "user", "x"), (None, 0, "user", "lost"), (9, 3, None, "y")]
    rows += [(103, t, "user", f"t{t}") for t in range(40)] + [(104, t, "user", f"t{t}") for t in range(40)]
    return rows


@pytest.mark.parametrize("width", [1, 4])
def test_trie_equals_brute_force(spark, turns, width):
    df = spark.createDataFrame(turns, TURNS).withColumn("depth", F.lit(0)).withColumn("n", F.lit("x")).repartition(5)
    got = trie.prefix_trie(trie.grafted(trie.numbered(df)), width=width)
    assert collected(got) == brute(rebuilt(turns))


def test_trie_of_plain_sequences(spark, turns):
    """Without grafting, conversations are sequences as they are."""
    rows = [r for r in turns if r[0] is not None and r[0] >= 100]
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append((r[2] or "", r[3] or ""))
    assert collected(trie.prefix_trie(trie.numbered(spark.createDataFrame(rows, TURNS)))) == brute(convs)


def test_nested_conversations(spark):
    """Every conversation is a prefix of the next: single children with different members."""
    rows = [(c, t, "u", f"w{t}") for c in range(12) for t in range(c + 1)]
    convs = {c: [("u", f"w{t}") for t in range(c + 1)] for c in range(12)}
    assert collected(trie.prefix_trie(trie.numbered(spark.createDataFrame(rows, TURNS)))) == brute(convs)


def test_turnless_and_empty(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(trie.grafted(trie.numbered(empty))).count() == 0
    # crc32("4") % 6 > 0 and no base: the only turn is cut off.
    only = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 1)
    got = trie.prefix_trie(trie.grafted(trie.numbered(spark.createDataFrame([(only, 0, "user", "x")], TURNS)))).collect()
    assert [tuple(r) for r in got] == [(only, 0, None, 1, 0, 1, 0, hashlib.sha256(str(only).encode()).hexdigest())]


def test_many_ends_are_hashed_in_order(spark):
    convs = spark.range(0, 9000, 1, 7).select(F.col("id").alias("conv"), F.lit(5).cast("bigint").alias("pa"), (F.col("id") % 2).alias("pb"))
    got = {r.pb: r.ends_sha256 for r in trie.hashed_ends(convs).collect()}
    assert got == {b: hashlib.sha256(",".join(str(i) for i in range(9000) if i % 2 == b).encode()).hexdigest() for b in (0, 1)}


def test_values_ahead_go_chunk_by_chunk(spark):
    rng = random.Random(1)
    rows = [(k, p, rng.randrange(1 << 40)) for k in range(3) for p in range(30 * k)]
    got = trie.ahead(spark.createDataFrame(rows, "k int, p bigint, v bigint"), ["k"], "p", {"s": F.col("v")}, {"x": F.col("v")}, 7).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [v for k, p, v in rows if k == r.k and p < r.p]
        xor = 0
        for v in before:
            xor ^= v
        assert (r.s, r.x) == (sum(before), xor)

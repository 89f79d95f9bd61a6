"""Near-dedup, decontamination and line dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalogspark.llm import decontam, lines, neardup
from catalogspark.llm.shingles import OnePermutation, shingle_sets

from .fixtures import corpus, documents, edited, words


def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingled(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def copies():
    """Bases with copies near the threshold, chains, exact copies, short and odd texts."""
    rng = random.Random(11)
    rows, n = [], 0
    for _ in range(12):
        base = words(rng, rng.choice([20, 60, 200]))
        rows.append((n, " ".join(base)))
        n += 1
        for _ in range(rng.choice([1, 5, 25])):
            rows.append((n, " ".join(edited(rng, base, rng.choice([0, 1, 1, 2, 3])))))
            n += 1
    chain = words(rng, 100)
    for _ in range(12):
        rows.append((n, " ".join(chain)))
        chain = edited(rng, chain, 2)
        n += 1
    shared = words(rng, 60)
    for _ in range(30):
        rows.append((n, " ".join(words(rng, 60) + shared)))
        n += 1
    for text in ("one", "one", "ONE", "one two three four", "One two  three\tfour", "a b c d e", "", "  ", None, "a b c d e f", "É a b c d", "é a b c d"):
        rows.append((n, text))
        n += 1
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark, copies):
    want = brute_components(copies)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents(spark, copies).withColumn("comp", F.lit(1))).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_components_of_the_corpus(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_components(rows)
    got = {r.id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert got == want


def test_near_dedup_defined_results(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    only = neardup.near_duplicates(documents(spark, [(1, None), (2, ""), (None, "some text"), (None, "some text"), (3, "some text"), (3, "some text")]))
    got = sorted(((r.id is None, r.id or 0, r.component_id, r.kept) for r in only.collect()), key=str)
    assert got == sorted([(False, 1, 1, True), (False, 2, 2, True), (True, 0, None, True), (True, 0, None, True), (False, 3, 3, True), (False, 3, 3, True)], key=str)
    docs = documents(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other")])
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_an_id_with_several_texts_is_linked_through_each(spark):
    rng = random.Random(5)
    a, b = words(rng, 80), words(rng, 80)
    rows = [(7, " ".join(a)), (7, " ".join(b)), (9, " ".join(edited(rng, a, 1))), (8, " ".join(edited(rng, b, 1))), (5, " ".join(words(rng, 80)))]
    got = sorted((r.id, r.component_id) for r in neardup.near_duplicates(documents(spark, rows)).collect())
    assert got == [(5, 5), (7, 7), (7, 7), (8, 7), (9, 7)]


def test_pairs_inside_a_crowd_below_the_threshold_are_found(spark):
    """Texts that share a passage are similar by 0.737; some pairs among them share three shingles more, 0.757."""
    rng = random.Random(17)
    passage, rows, want = words(rng, 200, 10 ** 9), [], {}
    for i in range(300):
        own = words(rng, 35, 10 ** 9)
        if i % 2 and i < 160:
            own[:3] = rows[i - 1][1].split()[200:203]
        rows.append((i, " ".join(passage + own)))
        want[i] = i - 1 if i % 2 and i < 160 else i
    got = {r.id: r.component_id for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert got == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    minhash, agree = OnePermutation(), []
    for _ in range(60):
        common, a, b = (np.unique(rng.integers(0, 2 ** 63, k, dtype=np.uint64) * np.uint64(2)) for k in (150, 25, 25))
        x, y = (minhash.bands(minhash.signature(np.union1d(common, s))) for s in (a, b))
        agree.append((x == y).mean())
    assert np.mean(agree) == pytest.approx(0.75 ** 4, abs=0.05)


@pytest.mark.parametrize("scale", [4, 12, 25, 100])
def test_the_quick_look_at_signatures_spares_similar_sets(scale):
    rng = np.random.default_rng(1)
    minhash, agree = OnePermutation(), {True: [], False: []}
    for similar, sizes in ((True, (6, 1, 1)), (False, (4, 6, 6))):
        for _ in range(300):
            common, a, b = (np.unique(rng.integers(0, 2 ** 63, k * scale, dtype=np.uint64) * np.uint64(2)) for k in sizes)
            x, y = (minhash.planes(minhash.signature(np.union1d(common, s))).view(np.uint64).reshape(4, 2) for s in (a, b))
            agree[similar].append(128 - sum(int(v).bit_count() for v in np.bitwise_or.reduce(x ^ y)))

    def least(n):
        filled = 128 * (1 - np.exp(-n / 128))
        return 128 * neardup.AGREE - neardup.DEVIATIONS * 128 * np.sqrt(neardup.AGREE * (1 - neardup.AGREE) / filled)

    assert min(agree[True]) >= least(7 * scale)
    assert scale < 12 or np.mean([v < least(10 * scale) for v in agree[False]]) > 0.9


def test_shingles_do_not_depend_on_neighbours():
    texts = ["a b c d e f", "", None, "x" * 70_000 + " b c d e", "é ê", "  lead and trail  "]
    alone = [next(iter(shingle_sets(pa.array([t], pa.string())))) for t in texts]
    for one, two in zip(alone, shingle_sets(pa.array(["q"] + texts, pa.string()).slice(1))):
        assert one.tolist() == two.tolist()


def brute_contamination(docs, items):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i:i + k])].add("" if item is None else str(item))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i:i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[g]
        out[doc] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([13, 14, 20, 40, 40, 60, 12, 5, 1, 2])]
    items += [(90, items[3][1]), (91, None), (92, "..."), (93, " ".join(["echo"] * 30)), (None, " ".join(words(rng, 15))), (95, "Ärger " * 14)]
    docs = [(i, " ".join(words(rng, rng.choice([0, 3, 12, 13, 300])))) for i in range(40)]
    for i in range(60):
        _, passage = rng.choice(items)
        cut = (passage or "").split()
        a = rng.randrange(len(cut) + 1)
        noise = words(rng, rng.choice([0, 5, 100]))
        docs.append((100 + i, " ".join(noise + cut[a:a + rng.choice([5, 12, 13, 30])] + noise).upper()))
    docs += [(900, None), (901, ""), (902, "?!"), (903, "echo, " * 40), (904, " ".join(t for _, t in items if t)), (905, "ärger " * 20)]
    got = decontam.contamination(documents(spark, docs).withColumn("items", F.lit(0)).withColumn("n", F.lit(0)), spark.createDataFrame(items, "item_id int, text string"))
    assert {r.id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()} == brute_contamination(docs, items)


def test_contamination_defined_results(spark):
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20)))], "item_id int, text string")
    dirty = " ".join(f"b{i}" for i in range(20))
    docs = documents(spark, [(1, dirty), (1, dirty), (None, dirty), (2, "clean words only")])
    got = sorted((str(r.id), r.n_hit) for r in decontam.contamination(docs, bench).collect())
    assert got == [("1", 20), ("1", 20), ("2", 0), ("None", 20)]
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()] == [2]
    assert decontam.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.contamination(documents(spark, []), bench).count() == 0


def test_registered_query_with_short_items(spark, tmp_path):
    items = [(1, "solo"), (2, "one two three four five"), (3, " ".join(f"t{i}" for i in range(12))), (4, "solo"), (10, "solo")]
    docs = [(1, "a solo b"), (2, "zero one two three four five six"), (3, " ".join(f"t{i}" for i in range(12))), (4, "one two three four"), (5, None)]
    folder = corpus(spark, tmp_path, documents(spark, docs), benchmark=spark.createDataFrame(items, "item_id bigint, text string"))
    got = {r.doc_id: r for r in decontam.op2_decontaminate(spark, folder).collect()}
    assert {i: (r.n_words, r.n_hit, r.n_items) for i, r in got.items()} == {1: (3, 1, 3), 2: (7, 5, 1), 3: (12, 12, 1), 4: (4, 0, 0), 5: (0, 0, 0)}
    assert got[1].items_sha256 == hashlib.sha256(b"1,10,4").hexdigest()


def test_items_digest(spark, sf):
    r = decontam.op2_decontaminate(spark, sf).filter("n_items = 0").first()
    assert r.items_sha256 == hashlib.sha256(b"").hexdigest()


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:] or a == b


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    bases = ["".join(rng.choice("abcd é") for _ in range(rng.choice([10, 23, 24, 25, 40, 80]))) for _ in range(40)]

    def line():
        x = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(x))
            x[i:i + rng.choice([0, 1])] = rng.choice(["", "z", "a"])
        return "".join(x)

    docs = [(i, "\n".join(line() for _ in range(rng.choice([1, 3, 8])))) for i in range(120)]
    docs += [(900, None), (901, ""), (902, "\n\n"), (903, "x" * 5000), (904, "x" * 5001)]
    all_lines = [(i, k, x) for i, t in docs if t is not None for k, x in enumerate(t.split("\n"))]
    firsts = {}
    for i, k, x in all_lines:
        if x:
            firsts.setdefault(x, (i, k))
    near = {x for x, at in firsts.items() if len(x) >= 24 and any(o < at and len(y) >= 24 and distance_one(x, y) for y, o in firsts.items() if y != x)}
    want = {i: (0, 0, 0, []) for i, _ in docs}
    for i, k, x in all_lines:
        n, eq, nr, kept = want[i]
        fate = 0 if not x else 1 if firsts[x] != (i, k) else 2 if x in near else 0
        want[i] = (n + 1, eq + (fate == 1), nr + (fate == 2), kept + [k] * (fate == 0))
    df = documents(spark, docs).withColumn("line_no", F.lit(1))
    got = {r.id: (r.n_lines, r.n_equal, r.n_near, r.kept_lines) for r in lines.line_dedup(df).collect()}
    assert got == want
    cut = {r.doc_id: r.text for r in lines.deduplicated(df).collect()}
    for i, t in docs:
        assert cut[i] == (None if t is None else "\n".join(t.split("\n")[k] for k in want[i][3]))


def test_deletion_hashes_meet():
    a, d = lines.deletion_hashes("abcdeéf")
    b, _ = lines.deletion_hashes("abdeéf")
    assert int(d[2]) == b and len(d) == 7 and lines.deletion_hashes("")[1].size == 0
    _, e = lines.deletion_hashes("abXdeéf")
    assert d[2] == e[2] and d[3] != e[3]


def test_lines_of_nothing(spark):
    assert lines.line_dedup(documents(spark, [])).count() == 0
    got = lines.line_dedup(documents(spark, [(1, "a line\na line"), (1, "a line\na line"), (None, "a line")])).collect()
    assert sorted((str(r.id), r.n_lines, r.n_equal) for r in got) in ([("1", 2, 1), ("None", 1, 1)], [("1", 2, 2), ("None", 1, 0)])


def test_lines_near_a_line_of_a_null_id(spark):
    line = "a line of more than twenty-four characters"
    got = lines.line_dedup(documents(spark, [(None, line), (1, line + "s"), (2, line.replace("more", "mare"))])).collect()
    assert sorted((str(r.id), r.n_lines, r.n_equal, r.n_near) for r in got) == [("1", 1, 0, 1), ("2", 1, 0, 1), ("None", 1, 0, 0)]

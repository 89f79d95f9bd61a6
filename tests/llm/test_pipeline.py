"""The pipeline against its stages done by hand, and on odd corpora."""

import random
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from catalogspark.llm import quality

from .fixtures import corpus, documents, edited, words
from .test_duplicates import brute_components, brute_contamination


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [(i, " ".join(words(rng, 30))) for i in range(5)]
    rows = []
    for i in range(240):
        w = words(rng, rng.choice([40, 120]), 3000)
        if i % 6 == 0:
            w = ["###", "$$$", "%%%"] * 30 + [str(i)]
        elif i % 6 == 1 and i > 6:
            w = edited(rng, rows[i - 2][1].split(), 1) if rows[i - 2][1] else w
        elif i % 6 == 2:
            w = w[:30] + rng.choice(items)[1].split()
        rows.append((i, " ".join(w), rng.choice(["a", "a", "b", None])))
    rows += [(500, None, "a"), (501, "", "b"), (502, "word " * 20_000, "a"), (503, rows[3][1], "c"), (503, rows[3][1], "c")]
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(240)], "doc_id bigint, quality int, toxic int")
    path = tmp_path_factory.mktemp("corpus")
    return corpus(spark, path, documents(spark, rows), labels=labels, benchmark=spark.createDataFrame(items, "item_id int, text string")), items


def test_stages_keep_what_they_should(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns + (["shard", "slot"] if name == "shard" else [])
        results.append([r.asDict() for r in docs.collect()])
    start = [r.asDict() for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    good, single, clean, mixed, sharded = results

    model = quality.learn(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    sizes = quality.Sizes(model["good"], model["bad"])
    scores = quality._scores(pa.array([r["text"] for r in start], pa.string()), sizes, model)
    assert sorted(r["doc_id"] for r in good) == sorted(r["doc_id"] for r, s in zip(start, scores) if s >= 0.3)
    assert not {r["doc_id"] for r in good} & set(range(0, 240, 6))

    comps = brute_components([(r["doc_id"], r["text"]) for r in good])
    assert {r["doc_id"] for r in single} == {i for i, (_, c) in comps.items() if i == c}
    dirty = brute_contamination([(r["doc_id"], r["text"]) for r in single], items)
    assert {r["doc_id"] for r in clean} == {i for i, d in dirty.items() if not d[3]}
    copies, sizes_of = Counter(r["doc_id"] for r in mixed), {r["doc_id"]: len((r["text"] or "").split()) for r in clean}
    assert set(copies) <= set(sizes_of) and max(copies.values()) <= 2
    assert sum(sizes_of[i] * n for i, n in copies.items()) == pytest.approx(1.5 * sum(sizes_of.values()), rel=0.3)
    assert Counter(r["doc_id"] for r in sharded) == copies
    assert {r["shard"] for r in sharded} <= set(range(corpus_pipeline.SHARDS))


def test_run_equals_its_stages_and_reruns(spark, folder):
    path, _ = folder
    one = Counter((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, path).collect())
    two = Counter((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, path).collect())
    assert one == two and len(one) > 50
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_an_empty_corpus(spark, folder, tmp_path):
    path, _ = folder
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    at = corpus(spark, tmp_path, empty, labels=spark.read.parquet(f"{path}/labels.parquet").limit(0), benchmark=spark.read.parquet(f"{path}/benchmark.parquet").limit(0))
    assert corpus_pipeline.run(spark, at).count() == 0

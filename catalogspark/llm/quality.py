"""Quality classifier from compressed sizes.

Two zstandard dictionaries are trained, one from texts labelled good and one from texts
labelled bad. A text compresses better with the dictionary of its own kind; the
difference of its two compressed sizes over its length, with the compressed sizes
themselves, is turned into a probability by a logistic fit on labelled texts that the
dictionaries have not seen.

Only rows outside the held-out fifth (``crc32(id as text) % 5 = 0``) train. At most
``PER_CLASS`` labelled texts per class, those with the smallest id hash, are fetched for the fit
(a bounded sample; labels are small, texts are fetched by id). Scoring is one pass over the
texts with no shuffle; labels, lang, source and id are not inputs.

Defined results: null counts as the empty text, which gets the score of size 0; a
corpus without labels of both kinds scores 0.5 everywhere; repeated rows score alike;
extra columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

PER_CLASS = 1200
DICT_BYTES = 48 * 1024
LEVEL = 3
KEEP_FROM = 0.3


def held_out(id_col: str | Column) -> Column:
    """Whether a row belongs to the fifth that never trains."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], id_col: str = "doc_id") -> list[tuple]:
    """(id, text, label) of at most ``per_class`` training rows for label 0 and 1, in id-hash order."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).filter(F.col("id").isNotNull() & ~held_out("id"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    ids: dict = {}
    for y, most in per_class.items():
        for r in known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most).collect():
            ids[r["id"]] = y
    if not ids:
        return []
    found = docs.filter(F.col(id_col).isin(list(ids))).select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text")).collect()
    best: dict = {}
    for r in found:  # an id with several texts trains on the smallest
        best[r["id"]] = min(best.get(r["id"], r["text"]), r["text"])
    order = {v: k for k, v in enumerate(ids)}
    return [(i, best[i], ids[i]) for i in sorted(best, key=order.get)]


def _dictionary(texts: list[bytes]) -> bytes:
    """Dictionary content from sample texts; their plain concatenation where there are too few."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICT_BYTES:] or b"\n" * 8


class Sizes:
    """Features of a text: compressed sizes with the good, the bad and no dictionary, over its length."""

    def __init__(self, good: bytes, bad: bytes):
        made = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        self.by = [*made, zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)]

    def __call__(self, raw: bytes) -> list[float]:
        n = len(raw) + 8.0
        good, bad, none = (len(c.compress(raw)) / n for c in self.by)
        return [bad - good, (bad - good) / (bad + good), good, none, np.log(n), (bad - good) * np.log(n)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic model (intercept last) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    weight = np.ones(len(x)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + keep * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + np.diag(keep), grad)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(sample: list[tuple], prior: float | None = None) -> dict | None:
    """The model: dictionaries, scaling and logistic weights; None without both classes."""
    texts = {y: [t.encode() for _, t, label in sample if label == y] for y in (0, 1)}
    if min(len(texts[0]), len(texts[1])) < 2:
        return None
    good, bad = _dictionary(texts[1][::2]), _dictionary(texts[0][::2])
    sizes = Sizes(good, bad)
    unseen = [(t, y) for y in (0, 1) for t in texts[y][1::2]] + [(b"", 1)]
    x, y = np.array([sizes(t) for t, _ in unseen]), np.array([y for _, y in unseen], float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    # Classes are sampled evenly; weights restore the share they have among the labels.
    share = y.mean() if prior is None else prior
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    return {"good": good, "bad": bad, "mean": mean, "scale": scale, "w": fit_logistic((x - mean) / scale, y, weight=weight)}


def learn(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Fit on the labelled training rows of ``docs``."""
    sample = labelled_sample(docs, labels, "quality", {0: PER_CLASS, 1: PER_CLASS})
    share = labels.filter(~held_out("doc_id")).agg(F.avg("quality")).first()[0]
    return train(sample, None if share is None else float(share))


def scored(docs: DataFrame, model: dict | None, *, text_col: str = "text") -> DataFrame:
    """(row, score in [0, 1]) with each row of ``docs`` as a struct."""
    return scored_slim(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("key"), F.col(text_col).alias("text")), model).withColumnRenamed("key", "row")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    return scored(docs, learn(docs, labels)).filter(F.col("score") >= KEEP_FROM).select("row.*")


def op5_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = learn(docs, labels)
    slim = docs.select("text", F.struct("doc_id").alias("key"))
    # The text goes in, the id comes back: results stay narrow.
    found = scored_slim(slim, model)
    return found.select(F.col("key.doc_id").alias("doc_id"), held_out("key.doc_id").alias("held_out"), "score",
                        (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def scored_slim(df: DataFrame, model: dict | None) -> DataFrame:
    """(key, score) for rows of (key, text)."""
    kind = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model["good"], model["bad"]) if model else None
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(_scores(texts, sizes, model))], names=["key", "score"])

    return df.mapInArrow(run, f"key {kind}, score double")


def _scores(texts: pa.Array, sizes: Sizes | None, model: dict | None) -> np.ndarray:
    if model is None or not len(texts):
        return np.full(len(texts), 0.5)
    x = np.array([sizes((t.as_py() or "").encode()) for t in texts])
    x = np.column_stack([(x - model["mean"]) / model["scale"], np.ones(len(x))])
    return 1 / (1 + np.exp(-np.clip(x @ model["w"], -30, 30)))

"""Toxicity by a classifier chain.

Categories are predicted one after the other; each later linear model also gets the
probabilities of the earlier categories, and is trained on out-of-fold predictions of
them, so it learns from probabilities as wrong as those it will meet.

``labels`` marks one thing, ``toxic``. The chain's earlier categories are derived from it
on the training rows: *dense* (toxic, with as many marker words as the upper half of
toxic texts) and *repeated* (toxic, with one marker at least twice), where a marker is a
feature seen almost only in toxic texts. ``toxic`` comes last and is the decision. With
other labels, ``fit`` takes any ordered mapping of categories.

Features are the presence of words (lower-cased runs of letters and digits) and of word
stems of 4 to 6 bytes, each scaled by its log-odds, as full 64-bit hashes, so no two
features share a bucket. The
vocabulary is picked from a bounded sample: at most ``PER_CLASS`` labelled training rows
per label (outside the held-out fifth), at most ``FEATURES`` features. Scoring is one pass
over whole texts without a shuffle. The cut between toxic and clean is the one with the
best F2 on the out-of-fold predictions.

Defined results: null counts as the empty text and scores the model's bias; without toxic
or without clean training rows every text scores 0 and none is toxic; repeated rows score
alike; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .quality import held_out, labelled_sample
from .shingles import PUNCTUATION, buffers, pieces, word_hashes

PER_CLASS = {1: 1500, 0: 2500}
FEATURES = 1200
STEMS = (4, 5, 6)
FOLDS = 3
CATEGORIES = ("dense", "repeated", "toxic")


def text_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For runs of texts: feature hashes, the text (within the run) of each, number of texts."""
    data, offsets = buffers(column)
    for i, j in pieces(offsets):
        words, bounds, *stems = word_hashes(data, offsets[i:j + 1], PUNCTUATION, STEMS)
        owner = np.repeat(np.arange(j - i), np.diff(bounds))
        kinds = [words] + [np.where(s == 0, s, s ^ np.uint64(k)) for k, s in zip(STEMS, stems)]
        hashes, owners = np.concatenate(kinds), np.tile(owner, len(kinds))
        some = hashes != 0
        yield hashes[some], owners[some], j - i


def counts_of(column: pa.Array, keys: np.ndarray) -> np.ndarray:
    """Occurrences of the features ``keys`` (sorted) in each text."""
    out = []
    for hashes, owners, n in text_features(column):
        at = np.searchsorted(keys, hashes)
        at[at == len(keys)] = 0
        hit = keys[at] == hashes
        flat = np.bincount(owners[hit] * len(keys) + at[hit], minlength=n * len(keys))
        out.append(flat.reshape(n, len(keys)).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, len(keys)), np.float32)


def pick_features(column: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of the features that tell most, which of them are markers, and their log-odds."""
    seen, base = [], 0
    for hashes, owners, n in text_features(column):
        pairs = np.unique(np.stack([hashes, (owners + base).astype(np.uint64)]), axis=1)
        seen.append(pairs)
        base += n
    hashes, owners = np.concatenate(seen, axis=1)
    keys, at = np.unique(hashes, return_inverse=True)
    bad = np.bincount(at, weights=toxic[owners.astype(np.int64)], minlength=len(keys))
    good = np.bincount(at, minlength=len(keys)) - bad
    n_bad, n_good = toxic.sum(), len(toxic) - toxic.sum()
    rate_bad, rate_good = (bad + 0.1) / (n_bad + 0.2), (good + 0.1) / (n_good + 0.2)
    odds = np.log(rate_bad / rate_good)
    gain = np.abs(rate_bad - rate_good) / np.sqrt(rate_bad / n_bad + rate_good / n_good)
    order = np.argsort(-np.where(bad + good >= 3, gain, 0), kind="stable")[:FEATURES]
    order = order[np.argsort(keys[order])]
    return keys[order], (odds[order] > 3) & (bad[order] >= 3), odds[order].astype(np.float32)


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Logistic weights (intercept last) by accelerated gradient descent; both classes weigh the same."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)]).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    weight = np.where(y > 0, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (len(y) - y.sum()), 1)).astype(np.float32)
    ahead, t = w, 1.0
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest curvature, which bounds the step
        probe = x.T @ (weight * (x @ (probe / max(np.linalg.norm(probe), 1e-12))))
    rate = np.float32(4 * len(x) / max(np.linalg.norm(probe), 1e-6))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - rate * (x.T @ (weight * (p - y)) / len(x) + ridge * np.append(ahead[:-1], 0).astype(np.float32))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + np.float32((t - 1) / after) * (new - w), new, after
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit(x: np.ndarray, targets: dict[str, np.ndarray], fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """One model per category in order, later ones fed with out-of-fold predictions of earlier
    ones; and the out-of-fold predictions themselves."""
    models, extra = [], np.zeros((len(x), 0), np.float32)
    for y in targets.values():
        full = np.column_stack([x, extra])
        models.append(fit_linear(full, y))
        p = np.zeros(len(x), np.float32)
        for k in range(FOLDS):
            p[fold == k] = probability(full[fold == k], fit_linear(full[fold != k], y[fold != k]))
        extra = np.column_stack([extra, p])
    return models, extra


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F2 (recall counts twice) on out-of-fold predictions, in the middle of its gap."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    f2 = 5 * np.cumsum(y) / (np.arange(1, len(y) + 1) + 4 * y.sum())
    f2[:-1][p[:-1] == p[1:]] = 0  # no cut between equals
    k = int(np.argmax(f2))
    return float((p[k] + p[min(k + 1, len(p) - 1)]) / 2)


def apply_chain(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    """Probabilities of all categories, each model fed with those before it."""
    for w in models:
        x = np.column_stack([x, probability(x, w)])
    return x[:, x.shape[1] - len(models):]


def train(sample: list[tuple]) -> dict | None:
    """The chain from (id, text, toxic); None without both labels."""
    y = np.array([label for *_, label in sample], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    column = pa.array([t for _, t, _ in sample], pa.large_string())
    keys, marks, odds = pick_features(column, y)
    counts = counts_of(column, keys)
    x = np.minimum(counts, 1) * odds
    markers = counts[:, marks].sum(axis=1)
    toxic = y == 1
    dense = toxic & (markers >= max(np.median(markers[toxic]), 1))
    repeated = toxic & (counts[:, marks].max(axis=1, initial=0) >= 2)
    targets = dict(zip(CATEGORIES, (dense.astype(np.float32), repeated.astype(np.float32), y)))
    models, unseen = fit(x, targets, np.arange(len(y)) % FOLDS)
    return {"keys": keys, "odds": odds, "models": models, "from": threshold(unseen[:, -1], y)}


def learn(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Fit on the labelled training rows of ``docs``."""
    return train(labelled_sample(docs, labels, "toxic", PER_CLASS))


def scored(df: DataFrame, model: dict | None) -> DataFrame:
    """(key, p) for rows of (key, text): the probabilities of all categories in order."""
    kind = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                if model is None:
                    p = np.zeros((len(batch), len(CATEGORIES)))
                else:
                    p = apply_chain(np.minimum(counts_of(batch.column("text"), model["keys"]), 1) * model["odds"], model["models"])
                flat = pa.array(p.astype(np.float64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * p.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "p"])

    return df.mapInArrow(run, f"key {kind}, p array<double>")


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    found = scored(docs.select(F.struct("doc_id").alias("key"), "text"), model)
    doc_id, p = F.col("key.doc_id"), F.col("p")
    return found.select(
        doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), p[0].alias("p_dense"), p[1].alias("p_repeated"),
        p[2].alias("score"), (p[2] >= (model["from"] if model else 1.0)).cast("int").alias("toxic"))

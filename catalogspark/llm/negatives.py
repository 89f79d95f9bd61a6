"""Hard-negative mining by threshold joins over an inverted index with suffix-norm bounds.

A threshold join finds all rows whose inner product with an anchor reaches a threshold t.
By Cauchy and Schwarz the first dimensions of a row, while their norm is under t over the
anchor's norm, cannot reach t alone: a row is indexed only from the dimension on where the
norm of its head passes that (``ThresholdIndex``). Lists are walked from the last
dimension to the first; partial scores are accumulated, and a row is given up once its
partial score plus the norms of what remains on both sides stay under t. What is left is
verified on whole vectors.

Anchors ask in two passes over all rows: for their best rows of the same label, the
positives, and then for the best rows of other labels under each positive's score. In every shard a
threshold begins high and is lowered, the index rebuilt for it, until the anchor's windows
are full there or the threshold is at the windows' lower end. A shard then returns at most
``positives`` rows an anchor, or ``negatives`` rows an anchor and positive, and the best of
all shards are taken.

Shards hold about SHARD_ROWS rows, dealt by a number of their own, so copies of one row
spread; anchors come in groups of at most about GROUP_ANCHORS. A task holds one shard and one group. Work
is anchors times rows by nature.

Defined results: rows with a null id or label, or a vector that is null, empty or holds a
null or non-finite component, take no part; vectors meet only those of their own length;
rows repeated are rows of their own, except that rows with the anchor's own id are neither
its positives nor its negatives; an id with several rows asks once, by its smallest label
and vector; a positive without negatives in its window gives no row; an empty table gives an
empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

SHARD_ROWS, GROUP_ANCHORS = 4096, 4096
#: Anchors searched together, and dimensions accumulated between two prunings.
TOGETHER, STRIDE = 64, 8
#: First thresholds of the search for positives, as shares of the highest possible score, and
#: of that for negatives, as shares of the lowest positive's score; then the windows' lower end.
FOR_POSITIVES, FOR_NEGATIVES = (0.7, 0.5, 0.35, 0.25, 0.15), (0.95, 0.88)
SLACK = 1e-9


class ThresholdIndex:
    """Rows indexed for all queries q whose threshold is at least ``ratio`` times the norm of q."""

    def __init__(self, rows: np.ndarray, ratio: float):
        square = rows * rows
        heads = np.sqrt(np.concatenate([np.zeros((len(rows), 1)), np.cumsum(square, axis=1)], axis=1))  # norm of the first p dimensions
        # Dimensions before ``first`` are not indexed: the head's norm stays under the ratio.
        first = np.maximum((heads * (1 + SLACK) < ratio).sum(axis=1) - 1, 0) if ratio > 0 else np.zeros(len(rows), np.int64)
        # Rows by their first indexed dimension: the list of each dimension is then a leading part of them.
        self.order = np.argsort(first, kind="stable")
        self.first, self.heads = first[self.order], heads[self.order]
        self.lists = np.where(np.arange(rows.shape[1]) >= self.first[:, None], rows[self.order], 0.0)

    def candidates(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that may reach the query's threshold; no pair that does is left out."""
        heads = np.sqrt(np.concatenate([np.zeros((len(queries), 1)), np.cumsum(queries * queries, axis=1)], axis=1))
        # Room for the rounding of sums, which is relative to the norms.
        least = least - SLACK * (np.abs(least) + 1e-3 * heads[:, -1] * self.heads[:, -1].max(initial=0))
        partial = np.zeros((len(queries), len(self.order)))
        alive = np.arange(len(self.order))
        for to in range(queries.shape[1], 0, -STRIDE):
            at = max(to - STRIDE, 0)
            # The rows of these lists are the first of those still alive.
            n = int(np.searchsorted(self.first[alive], to))
            partial[:, :n] += queries[:, at:to] @ self.lists[alive[:n], at:to].T
            # Not yet summed: the dimensions before this one, or all that are unindexed.
            p = np.maximum(self.first[alive], at)
            rest = heads[:, p] * self.heads[alive, p]
            able = partial + rest * (1 + SLACK) >= least[:, None]
            keep = able.any(axis=0)
            if not keep.all():
                alive, partial, able = alive[keep], partial[:, keep], able[:, keep]
            if not len(alive):
                break
        q, r = np.nonzero(able) if len(alive) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return q, self.order[alive[r]]


def norms_of(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))


def scores(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs; numbers too large for doubles are summed as Python integers."""
    most = max(int(np.abs(queries).max(initial=0)), int(np.abs(rows).max(initial=0)))
    kind = np.int64 if most * most * max(queries.shape[1], 1) < 1 << 62 else object
    out = np.zeros(len(q), kind)
    for a in range(0, len(q), 1 << 14):
        part = slice(a, a + (1 << 14))
        out[part] = (queries[q[part]].astype(kind) * rows[r[part]].astype(kind)).sum(axis=1)
    return out


def window_search(
    queries: np.ndarray, rows: np.ndarray, highs: np.ndarray, ladder: tuple[float, ...], floors: np.ndarray,
    full: Callable[[int, np.ndarray, np.ndarray], tuple[bool, list]],
) -> list[list]:
    """For each query what ``full`` makes of the rows that score at least a threshold.

    ``full(query, rows, scores)`` tells whether the query's windows are full, and gives its
    result. Thresholds are shares ``ladder`` of ``highs``, lowered for queries that are not
    full, and at last ``floors``.
    """
    out: list[list] = [[] for _ in queries]
    as_float, of_rows = queries.astype(np.float64), rows.astype(np.float64)
    norms = norms_of(queries)
    open_ = np.flatnonzero(floors < np.inf)
    for share in (*ladder, None):
        least = floors[open_] if share is None else np.maximum(floors[open_], share * highs[open_])
        ratios = np.divide(least, norms[open_], out=np.full(len(open_), -np.inf), where=norms[open_] > 0)
        left = []
        by_ratio = np.argsort(-ratios, kind="stable")
        for a in range(0, len(open_), TOGETHER):
            some = by_ratio[a:a + TOGETHER]
            index = ThresholdIndex(of_rows, ratios[some].min())
            q, r = index.candidates(as_float[open_[some]], least[some])
            exact = scores(queries[open_[some]], rows, q, r)
            hit = exact >= least[some][q]
            q, r, exact = q[hit], r[hit], exact[hit]
            order = np.argsort(q, kind="stable")
            q, r, exact = q[order], r[order], exact[order]
            bounds = np.searchsorted(q, np.arange(len(some) + 1))
            for k, i in enumerate(some):
                part = slice(bounds[k], bounds[k + 1])
                done, found = full(int(open_[i]), r[part], exact[part])
                if done or least[i] <= floors[open_[i]]:
                    out[open_[i]] = found
                else:
                    left.append(open_[i])
        open_ = np.array(sorted(left), np.int64)
        if not len(open_):
            break
    return out


def best(ids: np.ndarray, found: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (row, score): higher scores first, then smaller ids."""
    if len(rows) > 16 * k:
        # Only scores from the k-th on matter.
        last = np.sort(found)[-k]
        rows, found = rows[found >= last], found[found >= last]
    return sorted(zip(rows.tolist(), found.tolist()), key=lambda t: (-t[1], ids[t[0]]))[:k]


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def positives_of(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The task of one shard and one group of anchors: the anchors' best rows of their own label."""

    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(rows) and len(anchors):
            for label, asked in anchors.groupby("label"):
                same = rows[rows["label"] == label]
                if not len(same):
                    continue
                ids, asking = same["id"].to_numpy(), asked["id"].to_numpy()

                def full(i: int, r: np.ndarray, s: np.ndarray) -> tuple[bool, list]:
                    other = ids[r] != asking[i]
                    found = best(ids, s[other], r[other], k)
                    return len(found) == k, found

                queries, candidates = matrix(asked["v"]), matrix(same["v"])
                highs = norms_of(queries) * norms_of(candidates).max()
                found = window_search(queries, candidates, highs, FOR_POSITIVES, np.full(len(asked), -np.inf), full)
                out += [(int(asking[i]), int(ids[r]), s) for i, hits in enumerate(found) for r, s in hits]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])

    return run


def negatives_of(k: int, low: int, high: int, base: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The task of one shard and one group of anchors: the best rows of other labels in each positive's window."""

    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        if len(rows) and len(anchors):
            for label, asked in anchors.groupby("label"):
                others = rows[rows["label"] != label]
                if not len(others):
                    continue
                ids, asking = others["id"].to_numpy(), asked["id"].to_numpy()
                wanted = [[int(x) for x in w] for w in asked["wanted"]]  # positive scores
                ends = [[(-(-low * p // base), high * p // base) for p in w] for w in wanted]

                def full(i: int, r: np.ndarray, s: np.ndarray) -> tuple[bool, list]:
                    other = ids[r] != asking[i]
                    r, s = r[other], s[other]
                    hits, done = [], True
                    for n, (least, most) in enumerate(ends[i]):
                        inside = (s >= least) & (s <= most)
                        found = best(ids, s[inside], r[inside], k)
                        # An empty window is full.
                        done = done and (len(found) == k or least > most)
                        hits += [(n, a, b) for a, b in found]
                    return done, hits

                # Without a window that can hold a score, nothing is searched.
                floors = np.array([float(min((a for a, b in e if a <= b), default=np.inf)) for e in ends])
                highs = np.array([float(min((b for a, b in e if a <= b), default=np.inf)) for e in ends])
                found = window_search(matrix(asked["v"]), matrix(others["v"]), highs, FOR_NEGATIVES, floors, full)
                out += [(int(asking[i]), n + 1, int(ids[r]), s) for i, hits in enumerate(found) for n, r, s in hits]
        return pd.DataFrame(out, columns=["anchor_id", "nth", "negative_id", "negative_score"])

    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v, dim): the rows that take part, each component x as floor(scale * x)."""
    good = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).filter(good)
    v = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return some.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), v.alias("v"), F.size(vec_col).alias("dim"))


def hard_negatives(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    every: int = 100, positives: int = 5, negatives: int = 5, scale: int = 256, window: tuple[int, int, int] = (80, 100, 100),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``. A negative's score lies between
    ``window[0]`` and ``window[1]`` parts in ``window[2]`` of its positive's.
    """
    # Numbered once it is fixed in files: copies of a row then lie in several shards.
    rows = written(usable(vectors, id_col, vec_col, label_col, scale).withColumn("seq", F.monotonically_increasing_id()))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int")).drop("seq")
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v", "dim")).alias("a")).select("id", "a.*")
    asked = written(asked)
    groups = max(1, -(-asked.count() // GROUP_ANCHORS))

    def searched(anchors: DataFrame, task: Callable, schema: str) -> DataFrame:
        everywhere = anchors.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
        everywhere = everywhere.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        spread = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        key = ["dim", "shard", "group"]
        return spread.groupBy(*key).cogroup(everywhere.groupBy(*key)).applyInPandas(task, schema)

    found = searched(asked, positives_of(positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id"))
    best_ = written(found.withColumn("nth", nth).filter(F.col("nth") <= positives))

    wanted = best_.groupBy(F.col("anchor_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))).alias("w"))
    with_windows = asked.join(wanted, F.col("id") == F.col("of")).select("id", "label", "v", "dim", F.col("w.positive_score").alias("wanted"))
    under = searched(with_windows, negatives_of(negatives, *window), "anchor_id bigint, nth int, negative_id bigint, negative_score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "nth").orderBy(F.col("negative_score").desc(), "negative_id"))
    ranked = under.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return ranked.join(best_, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

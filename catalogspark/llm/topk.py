"""Exact top-k by inner product, with a k-d tree per shard.

Vectors are cut into shards of about SHARD_ROWS by a hash of their id. A shard's task
builds a k-d tree (median splits on the widest dimension, tight boxes) and answers blocks
of queries best-first: nodes are visited by the largest inner product that any
vector of their box could have, until that bound falls below the query's k-th score.

Two rounds: first every query searches one shard, which gives it a k-th score; then all
other shards are searched with that score as the starting bound. A shard returns at most k
rows per query, and the k best of all are taken.

Queries are packed in blocks of at most BLOCK_QUERIES; a task holds one shard and one
group of blocks, each of bounded size, so neither the queries nor the vectors ever meet whole.

Defined results: vectors that are null or hold a null or non-finite component take no part;
vectors are compared only with vectors of their own length; equal scores go to the smaller
id; rows repeated with one id are candidates of their own, except for a query's own id; a
query with fewer than k candidates gets all; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

SHARD_ROWS = 4096
BLOCK_QUERIES = 512
GROUP_BLOCKS = 16
LEAF = 128


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v, dim): the usable vectors with each component x as floor(scale * x)."""
    good = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = vectors.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.col(id_col).isNotNull()).filter(good)
    v = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return some.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), F.size(vec_col).alias("dim"))


class KdTree:
    """Median splits on the widest dimension, down to LEAF rows, each node with its tight box."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, left, right
        lows, highs = [], []

        def build(a: int, b: int) -> int:
            rows = x[self.order[a:b]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            me = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            lows.append(low)
            highs.append(high)
            widest = int(np.argmax(high - low))
            if b - a > LEAF and high[widest] > low[widest]:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, widest], mid)]
                self.nodes[me] = (a, b, build(a, a + mid), build(a + mid, b))
            return me

        build(0, len(x))
        self.low, self.high = np.array(lows), np.array(highs)
        self.x = x[self.order]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and node, the largest inner product within the node's box."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, q: np.ndarray, bound: np.ndarray, ids: np.ndarray, own: int, k: int, floor: float) -> list[tuple[float, int]]:
        """The k best (score, id), best first, of scores at least ``floor``."""
        best: list[tuple[float, int]] = []  # heap of (score, -id): the worst first
        heap = [(-bound[0], 0)]
        while heap:
            limit = max(floor, best[0][0]) if len(best) == k else floor
            up, node = heapq.heappop(heap)
            if -up < limit:
                break
            a, b, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], left))
                heapq.heappush(heap, (-bound[right], right))
                continue
            scores = self.x[a:b] @ q
            for i in np.flatnonzero(scores >= limit):
                if ids[a + i] == own:
                    continue
                item = (scores[i], -ids[a + i])
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return sorted(((s, -i) for s, i in best), key=lambda t: (-t[0], t[1]))


def searcher(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The task of one (shard, group): its vectors and its query blocks."""

    def run(vectors: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(vectors) and len(blocks):
            # Sums up to 2 ** 53 are exact in doubles; larger numbers are summed as Python integers.
            x = np.array(vectors["v"].tolist(), dtype=np.int64)
            queries = [(b.ids, np.frombuffer(b.matrix, np.int64).reshape(len(b.ids), -1), b.floors) for b in blocks.itertuples()]
            most = max([int(np.abs(x).max()), *(int(np.abs(q).max()) for _, q, _ in queries if q.size)])
            kind = np.float64 if most * most * x.shape[1] < 1 << 53 else object
            tree = KdTree(x.astype(kind))
            ids = vectors["id"].to_numpy(np.int64)[tree.order].tolist()
            for own, q, floors in queries:
                q = q.astype(kind)
                bounds = tree.bounds(q)
                for i in range(len(q)):
                    for score, vec in tree.search(q[i], bounds[i], ids, int(own[i]), k, floors[i]):
                        out["query_id"].append(int(own[i]))
                        out["vec_id"].append(vec)
                        out["score"].append(int(score))
        return pd.DataFrame({c: pd.Series(v, dtype="int64") for c, v in out.items()})

    return run


def packed(queries: DataFrame) -> DataFrame:
    """Blocks of queries (block, group, dim, home): ids, their matrix as bytes, and starting bounds."""

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id")
        return pd.DataFrame({
            "block": [df["block"].iloc[0]], "dim": [df["dim"].iloc[0]], "home": [df["home"].iloc[0]], "ids": [df["id"].tolist()],
            "matrix": [np.array(df["v"].tolist(), np.int64).tobytes()], "floors": [df["floor"].tolist()]})

    return queries.groupBy("dim", "home", "block").applyInPandas(
        pack, "block int, dim int, home int, ids array<bigint>, matrix binary, floors array<double>")


RESULT = "query_id bigint, vec_id bigint, score bigint"


def top_k(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, scale: int = 64,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``, against all rows."""
    rows = written(quantised(vectors, id_col, vec_col, scale))
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    asked = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "dim"])
    blocks = max(1, -(-max(total // every, 1) // BLOCK_QUERIES))
    groups = -(-blocks // GROUP_BLOCKS)
    asked = asked.withColumn("home", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).cast("int"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(max(1, -(-blocks // shards)))).cast("int")).drop("shard")

    # Round one: every query in its home shard.
    first_blocks = packed(asked.withColumn("floor", F.lit(float("-inf")))).withColumn("shard", F.col("home"))
    first = rows.groupBy("dim", "shard").cogroup(first_blocks.groupBy("dim", "shard")).applyInPandas(searcher(k), RESULT)
    first = written(first)
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    floors = kth.select(F.col("query_id").alias("of"), F.when(F.col("n") >= k, F.col("least").cast("double")).alias("known"))

    # Round two: all other shards, from the known k-th score on.
    bounded = asked.join(floors, F.col("id") == F.col("of"), "left").withColumn("floor", F.coalesce("known", F.lit(float("-inf"))))
    second_blocks = packed(bounded).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")
    second_blocks = second_blocks.withColumn("group", F.pmod(F.xxhash64("block", "home"), F.lit(groups)).cast("int"))
    spread = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    second = spread.groupBy("dim", "shard", "group").cogroup(second_blocks.groupBy("dim", "shard", "group")).applyInPandas(searcher(k), RESULT)

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP7_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

"""Small hand-made tables."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, extra=""):
    """Documents from (doc_id, text[, source]) rows."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng: random.Random, n: int, vocabulary: int = 5000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng: random.Random, text: list[str], changes: int) -> list[str]:
    out = list(text)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10 ** 6)}"
    return out


def corpus(spark, tmp_path, documents_df, **tables):
    """The tables written as a corpus folder."""
    documents_df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)

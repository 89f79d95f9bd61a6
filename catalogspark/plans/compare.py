"""Side-by-side check of registered queries against DuckDB on the same parquet files."""

from __future__ import annotations

import glob
import math
import os

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str):
    """DuckDB with the tables of a folder as views."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def multiset(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    """Columns in name order and the rows, sorted, in a form both engines share."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def differences(columns: list[str], rows: list, con, sql: str) -> list[str]:
    """Readable differences; empty when results agree."""
    got_cols, got = multiset(columns, [tuple(r) for r in rows])
    cursor = con.execute(sql)
    want_cols, want = multiset([d[0] for d in cursor.description], cursor.fetchall())
    out = []
    if got_cols != want_cols:
        out.append(f"columns {got_cols} != {want_cols}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want and not out:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        out.append(f"{len(bad)} rows differ, first: {bad[0][0]} != {bad[0][1]}")
    elif got != want:
        extra = [g for g in got if g not in set(want)][:2]
        missing = [w for w in want if w not in set(got)][:2]
        out.append(f"only spark {extra}; only sql {missing}")
    return out

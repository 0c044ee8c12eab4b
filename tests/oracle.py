"""Run a query and its oracle side by side and describe the first difference."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when columns, row count and every value agree exactly."""
    names = df.columns
    got = _rows(names, df.collect())
    cur = con.execute(sql)
    wanted_names = [d[0] for d in cur.description]
    want = _rows(wanted_names, cur.fetchall())
    if sorted(names) != sorted(wanted_names):
        return f"columns {sorted(names)} != {sorted(wanted_names)}"
    if len(got) != len(want):
        extra = sorted(set(got) - set(want), key=repr)[:2]
        lost = sorted(set(want) - set(got), key=repr)[:2]
        return f"rows {len(got)} != {len(want)}; only ours {extra}; only oracle {lost}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {sorted(names)}: {bad[0]}"
    return None

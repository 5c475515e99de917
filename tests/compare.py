"""Compare a Spark result with its SQL twin run by DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    answer = con.execute(sql)
    names = [c[0] for c in answer.description]
    kinds = {c[0]: str(c[1]) for c in answer.description}
    want_cols, want = rows_of(names, answer.fetchall())
    if cols != want_cols:
        return f"columns {cols} against {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {cols} {bad[0][0]} against {bad[0][1]}"
    for name, kind in df.dtypes:
        twin = kinds[name].upper()
        same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        if same.get(kind) and twin not in (same[kind], "NUMBER", "STRING", "BOOL", "FLOAT"):
            return f"type of {name}: {kind} against {twin}"
    return None

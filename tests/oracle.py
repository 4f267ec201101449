"""Spark's rows against DuckDB's, over the same tables."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(table) -> list[str]:
    names = sorted(table.column_names)
    return sorted(repr(tuple(r[n] for n in names)) for r in table.to_pylist())


def duck(folder: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    out = con.sql(sql).arrow()
    return out.read_all() if hasattr(out, "read_all") else out


def same(df, folder: str, sql: str) -> None:
    got, want = df.toArrow(), duck(folder, sql)
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)

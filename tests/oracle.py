"""Holds a query's rows against DuckDB's, column by column by name, in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def _cell(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, str):
        return v
    return str(int(v)) if float(v) == int(v) else f"{float(v):.6f}"


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(_cell(v) for v in r) for r in df.itertuples(index=False))


def compare(frame, connection, sql):
    mine, theirs = frame.toPandas(), connection.execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)

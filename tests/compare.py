"""Spark rows against DuckDB rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 9)
        return x

    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, f, sql):
    df = f(spark, sf_dir)
    mine = normal([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = normal(result.fetchall(), names)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    assert len(mine) == len(theirs), (len(mine), len(theirs), mine[:2], theirs[:2])
    for a, b in zip(mine, theirs, strict=True):
        assert a == b, (a, b)

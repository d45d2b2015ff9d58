"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return float(value) if isinstance(value, decimal.Decimal) else value


def rows(columns: list[str], found) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def oracle(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    db = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    done = db.execute(sql)
    names = [d[0] for d in done.description]
    return sorted(names), rows(names, done.fetchall())


def same(spark, folder: str, query, sql: str) -> None:
    df = query(spark, folder)
    names, expected = oracle(folder, sql)
    assert sorted(df.columns) == names
    assert rows(df.columns, df.collect()) == expected

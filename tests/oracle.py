"""Holds a query's rows against those of its SQL over the same tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if path.is_file() else f'{path}/*.parquet'}')")
    return db


def plain(x):
    """A value that compares alike from either engine."""
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else float(f"{float(x):.12g}")
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in values))


def differences(spark, query, sql, sf_dir):
    """Columns and the first rows that only one side has; empty if both agree."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [[v.asDict(True) if hasattr(v, "asDict") else v for v in r] for r in df.collect()])
    found = connect(sf_dir).execute(sql)
    names = [c[0] for c in found.description]
    want = rows(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return [sorted(df.columns), sorted(names)]
    return [] if got == want else [len(got), len(want), sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]]

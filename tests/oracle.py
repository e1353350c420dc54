"""Compare a registered query with its oracle SQL in DuckDB: same columns, same rows, in any order."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.date() if x.time() == datetime.time() else x
    if hasattr(x, "as_tuple"):
        return round(float(x), 6)
    return x


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.sql(sql)
    return sorted(got.columns), got.fetchall(), got.columns


def differences(df, sql, sf_dir):
    """None, or what differs."""
    names, rows, order = rows_of_sql(sql, sf_dir)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    want = sorted((tuple(value(r[order.index(c)]) for c in names) for r in rows), key=repr)
    got = sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=repr)
    if got != want:
        only = [g for g in got if g not in set(want)][:3] if len(got) < 50_000 else []
        lack = [w for w in want if w not in set(got)][:3] if len(got) < 50_000 else []
        return f"{len(got)} and {len(want)} rows; only here {only}; lacking {lack}"
    return None

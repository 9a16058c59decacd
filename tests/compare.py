"""Runs registered queries against their SQL on the same tables."""

import datetime
import decimal
import math

import duckdb


def connect(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 10**8 else str(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


def differ(df, con, sql):
    """None if both give the same rows, else a short account."""
    cur = con.execute(sql)
    names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    mine, got = rows_of(df.columns, df.collect())
    if names != mine:
        return f"columns {mine} and {names}"
    if got == want:
        return None
    known, mine = set(want), set(got)
    extra, lacking = [r for r in got if r not in known][:2], [r for r in want if r not in mine][:2]
    return f"{len(got)} and {len(want)} rows; only here {extra}; only in SQL {lacking}"

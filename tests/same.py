"""Runs a query and its SQL and compares rows."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(_plain, v)) if isinstance(v, list) else v


def rows(table):
    return Counter(tuple(str(_plain(v)) for _, v in sorted(r.items())) for r in table.to_pylist())


def assert_same(df, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    want = con.sql(sql).to_arrow_table()
    assert sorted(df.columns) == sorted(want.column_names)
    got, want = rows(df.toArrow()), rows(want)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])

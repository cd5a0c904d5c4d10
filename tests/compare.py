"""Run a query and its SQL over the same tables and compare the rows."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder=DATA):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(folder):
        c.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return c


def _plain(v):
    if v is None or str(v) in ("NaT", "<NA>", "nan", "None"):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return float(v)
    try:
        return round(float(v), 9) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_plain(v) for v in r) for r in frame.astype(object).itertuples(index=False, name=None)), key=str)


def same(spark, con, query, sql, folder=DATA):
    a, b = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)

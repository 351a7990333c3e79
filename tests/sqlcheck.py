"""Run a query and its SQL side by side."""

import os

import duckdb


def views(sf: str):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def normal(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(str(v) for v in row) for row in frame[names].itertuples(index=False))


def assert_same(spark, sf: str, run, sql: str) -> None:
    got, want = normal(run(spark, sf).toPandas()), normal(views(sf).execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]

"""Compare a query with its SQL on the same tables."""

import os

import duckdb


def same_as_sql(spark, sf, name, module):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{sf}/{t}')")
    df = module.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({module.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert len(got) == len(want) and sorted(map(repr, got)) == sorted(map(repr, want))

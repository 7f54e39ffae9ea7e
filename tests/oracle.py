"""Run a query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import os

import duckdb


def same_rows(spark, query, sql: str, sf_dir: str) -> tuple[list, list]:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        name = f.removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.execute(sql)
    names = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(n) for n in names]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == names, (sorted(df.columns), names)

    def plain(x):
        return round(float(x), 9) + 0.0 if isinstance(x, float) else x

    rows = lambda rs: sorted((tuple(plain(v) for v in r) for r in rs), key=repr)
    return rows(df.select(*names).collect()), rows([tuple(r[i] for i in order) for r in want.fetchall()])

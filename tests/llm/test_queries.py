"""The queries that have SQL, against it on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, name):
    db = duckdb.connect()
    for t in os.listdir(DATA):
        db.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert got == sorted(map(str, db.execute(f"SELECT {quoted} FROM ({queries.ORACLE[name]}) q").fetchall())) and got

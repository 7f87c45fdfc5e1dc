"""Every query against its SQL twin in DuckDB, on the smallest tables."""

import duckdb
import pytest

from fragmenta.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(x):
        if isinstance(x, float):
            return f"{x + 0.0:.6g}"
        return str(int(x)) if isinstance(x, bool) else str(x)

    return sorted(tuple(cell(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every registered evidence-table query against its SQL, on the smallest tables."""

import duckdb
import pytest

from dossier.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def _rows(rows):
    return sorted(tuple(repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, duck):
    got = registry.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    rows = _rows(got.select(*columns).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == columns
    assert rows == _rows(duck.sql(f"select {', '.join(columns)} from ({sql})" if all(c.isidentifier() and c not in ("real",) for c in columns) else "select " + ", ".join(f'"{c}"' for c in columns) + f" from ({sql})").fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query that has SQL gives the rows of its SQL, on all rows of the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from mendwell.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, str(DATA))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    q = con.execute(registry.oracle_sql()[name])
    assert got == rows([d[0] for d in q.description], q.fetchall())


def test_every_query_has_a_name_of_its_own():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) == sum(len(p.QUERIES) for p in registry.PARTS)

"""Every registered query of the reference's work against its SQL on the smallest tables."""

import duckdb
import pytest

from mulberry.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(found):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in found)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(map(tuple, df.select(*cols).collect()))
    if name in ORACLES:
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
        assert got == rows(want)
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every query of the moves against its SQL on the smallest tables."""

import duckdb
import pytest

from driftwell.queries import ORACLE_SQL, QUERIES

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{ROOT}/{t}.parquet')")
    return con


def rows(values):
    plain = (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values)
    return sorted(plain, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, ROOT)
    columns = sorted(found.columns)
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert rows(tuple(r) for r in found.select(columns).collect()) == rows(expected)

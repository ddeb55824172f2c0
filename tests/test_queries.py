"""Every registered query with a twin against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tidemetric.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.5g}" if abs(v) > 1e-7 else "0"
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="session")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return con


def test_twins_name_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_its_twin(spark, duck, tiny, name):
    df = catalogue.queries()[name](spark, tiny)
    columns = sorted(df.columns)
    got = canonical(tuple(r[c] for c in columns) for r in df.collect())
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = canonical(tuple(float(r[names.index(c)]) if type(r[names.index(c)]).__name__ == "Decimal" else r[names.index(c)] for c in columns) for r in found.fetchall())
    assert got == want

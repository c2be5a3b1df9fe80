"""Every registered query of the sequence engine against its SQL on the smallest tables."""

import duckdb
import pytest

from contextvine.plans.oracle import ORACLE_SQL
from contextvine.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda x: "null" if x is None or x != x else f"{x + 0.0:.5f}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(v[k]) for k in order) for v in values)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    want = oracle.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0

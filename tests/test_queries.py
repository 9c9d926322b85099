"""Every query that has SQL equals it; the others run and keep their schema."""

import math

import duckdb
import pytest

import __spark_entry__
from proofsheet.plans.registry import REGISTRY

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return repr(v)


def normal(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.oracle))
def test_equals_sql(spark, duck, name):
    query = REGISTRY[name]
    df = query.run(spark, SMALL)
    got = duck.execute(query.sql())
    names = [d[0] for d in got.description]
    assert df.columns == names
    assert normal(df.columns, df.collect()) == normal(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if not q.oracle))
def test_runs(spark, name):
    df = REGISTRY[name].run(spark, SMALL)
    assert [(c, k) for c, k in REGISTRY[name].columns] and df.collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).collect()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

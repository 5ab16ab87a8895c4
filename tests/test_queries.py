"""Every query that has SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from sieveline import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, isinstance(x, str), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    df = plans.queries()[name](spark, sf)
    got = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(plain(r[names.index(c)]) for c in df.columns) for r in got.fetchall()]
    assert in_order([tuple(map(plain, r)) for r in df.collect()]) == in_order(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_rows_only(spark, sf, name):
    assert plans.queries()[name](spark, sf).count() > 0

"""Every registered query against its SQL."""

import math
from collections import Counter

import duckdb
import pytest

from symweave.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        return
    result = con.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    expected = Counter(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order) for r in result.fetchall())
    assert sum(got.values()) == sum(expected.values()), (sum(got.values()), sum(expected.values()))
    assert got == expected, [list((got - expected).items())[:3], list((expected - got).items())[:3]]

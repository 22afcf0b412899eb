"""Every query that has SQL gives the same rows and columns as DuckDB on the same tables."""

import duckdb
import pytest

from docloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(row):
    return tuple(round(float(x), 9) if type(x).__name__ in ("float", "Decimal") else x for x in row)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = [plain(r[c] for c in cols) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    q = duck.execute(sql)
    at = [d[0] for d in q.description]
    assert sorted(at) == cols
    want = [plain(r[at.index(c)] for c in cols) for r in q.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(rows, key=key) == sorted(want, key=key)

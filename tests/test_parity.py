"""Each registered query of the library proper against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from corvane.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return str(value)
    try:
        x = float(value)
        return str(int(x)) if math.isfinite(x) and x == int(x) else f"{x:.6g}"
    except (TypeError, ValueError):
        return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    found = con.execute(registry.ORACLE_SQL[name])
    want = table([d[0] for d in found.description], found.fetchall())
    assert table(got.columns, [tuple(r) for r in got.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    got = registry.QUERIES[name](spark, SF)
    assert got.columns and got.count() >= 0

"""Every memory query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from memloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return str(value) if not isinstance(value, int) or isinstance(value, bool) else f"{value:.6g}"


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted([plain(r[i]) for i in order] for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    got = registry.queries()[name](spark, SF)
    want = oracle.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())

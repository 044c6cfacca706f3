"""Every registered library query runs on the smallest tables, and gives its SQL's rows where it has SQL."""

import math

import duckdb
import pytest

from quillstone.queries import FLAGSHIP, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool) or not isinstance(value, int | float):
        return str(value)
    return f"{value:.6g}" if value != int(value) else int(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([plain(row[k]) for k in order]) for row in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = [tuple(r) for r in df.collect()]
    if name in ORACLE_SQL:
        cursor = duck.execute(ORACLE_SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, found) == rows(columns, cursor.fetchall())


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and set(ORACLE_SQL) <= set(QUERIES)

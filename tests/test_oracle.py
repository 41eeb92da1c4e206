"""Every query against its SQL in DuckDB, on the same files."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_points
from mendline.workloads.oracle import ORACLE
from mendline.workloads.queries import QUERIES
from conftest import SF_SMALL, plan_text, rows_of

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_SMALL}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= entry_points.queries().items()
    assert ORACLE.items() <= entry_points.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    for word in ("Python", "Pandas", "CartesianProduct", "NestedLoop"):
        assert word not in plan_text(df)
    result = duck.execute(ORACLE[name])
    theirs = {column[0]: str(column[1]) for column in result.description}
    rows = result.fetchall()
    ours = {c: TYPES.get(t, t.upper()) for c, t in df.dtypes}
    assert ours == {c: t.replace(" ", "") for c, t in theirs.items()}
    columns = sorted(ours)
    at = [list(theirs).index(c) for c in columns]
    expected = sorted(repr(tuple(row[i] for i in at)) for row in rows)
    assert sorted(repr(tuple(row[c] for c in columns)) for row in df.collect()) == expected
    assert expected


def test_expected_plan(spark):
    counts = entry_points.entry(spark).groupBy("action").count().collect()
    assert {r["action"]: r["count"] for r in counts} == {"SKIP": 62, "REPAIR": 14, "INSERT": 7}


@pytest.mark.parametrize(
    "name", ["headers_source", "headers_target", "fetch_source_block", "period_of_sale"]
)
def test_results_do_not_depend_on_the_session_zone(spark, name):
    zone = spark.conf.get("spark.sql.session.timeZone")
    expected = rows_of(QUERIES[name](spark, SF_SMALL))
    try:
        for other in ("America/Sao_Paulo", "Pacific/Apia", "Pacific/Kiritimati"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert rows_of(QUERIES[name](spark, SF_SMALL)) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)

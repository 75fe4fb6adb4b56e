"""Every query that has SQL, against DuckDB on the smallest test tables."""

import math
import os

import pytest

from ridgeline.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def comparable(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(v) if isinstance(v, list) else v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(comparable(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.columns, df.collect()) == table(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs_with_a_stable_schema(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns and df.collect() is not None


def test_checksum_is_of_the_rows_and_not_of_their_order(spark, duck):
    found = queries.QUERIES["corpus_checksum"](spark, DATA).first()
    want = duck.execute(f"SELECT count(*), count(DISTINCT record_id), min(record_id), max(record_id) FROM ({queries.EVENTS.sql})").fetchone()
    assert (found.records, found.keys, found.first_key, found.last_key) == want and found.files == 1
    rows = queries.EVENTS.load(spark, DATA)
    sums = [queries.files.corpus_info(x).first().checksum for x in (rows.repartition(7), rows.union(rows.limit(1)), rows.where(f"record_id <> {found.last_key}"))]
    assert sums[0] == found.checksum and len({found.checksum, *sums}) == 3


def test_a_report_is_the_json_of_its_sql_whatever_its_numbers(spark, duck, tmp_path):
    """Sums from ten million on, and no accepted experiment at all: Java's exponents and left out fields aren't the SQL's."""
    for name, change in (("large", "value * 1e4"), ("none accepted", "least(value, 60)"), ("without events", "value")):
        data = f"{tmp_path}/{name}"
        os.mkdir(data)
        duck.execute(f"COPY (SELECT * REPLACE ({change} AS value) FROM events {'LIMIT 0' if name == 'without events' else ''}) TO '{data}/events.parquet'")
        want = duck.execute(queries.ORACLE_SQL["report_json"].replace("FROM events", f"FROM '{data}/events.parquet'")).fetchall()
        assert [tuple(r) for r in queries.QUERIES["report_json"](spark, data).collect()] == want
        assert ("null" in want[0][0]) == (name != "large")


def test_numbers_of_json_are_those_of_the_sql(spark, duck):
    rows = [0.0, -0.0, 1.0, 0.1, 15995248.2, 1e7, -2.5e9, 9007199254740993.0, 1e-6, 1.25e-6, 9.99e-7, 1e-7, -1.5e-7, 5e-324, 1e20, 1.2345678901234568e20, 1e21, 1.5e21, 1.25e300, 2.0**-44, None, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(i, x, None if i % 2 else f'"{i}"') for i, x in enumerate(rows)], "place int, `a.b` double, name string")
    got = [r[0] for r in df.orderBy("place").select(queries.artifacts.json_column(df)).collect()]
    assert got == [duck.execute('SELECT CAST(to_json(t) AS VARCHAR) FROM (SELECT ?::INTEGER AS place, ?::DOUBLE AS "a.b", ?::VARCHAR AS name) t', list(r)).fetchone()[0] for r in df.orderBy("place").collect()]

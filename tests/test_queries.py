"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidegraph import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(r) for r in frame.where(frame.notna(), None).itertuples(index=False)), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, expected = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_node_analytics_of_all_nodes(spark, duck):
    got = {r["nid"] for r in catalogue.QUERIES["node_analytics"](spark, SF).select("nid").collect()}
    seen = "SELECT user_id AS nid FROM events WHERE event_type <> 'error' UNION SELECT regexp_extract(props, '[0-9]+')::BIGINT + 1000 FROM events WHERE event_type NOT IN ('signup', 'error')"
    assert got == {n for (n,) in duck.sql(seen).fetchall()}


def test_time_encoding_has_both_messages_of_every_edge(spark, duck):
    got = catalogue.QUERIES["time_encoding"](spark, SF).toPandas()
    (edges,) = duck.sql("SELECT count(*) FROM events WHERE event_type NOT IN ('signup', 'error')").fetchall()[0]
    assert len(got) == 2 * edges and not got.duplicated(["event_idx", "role"]).any()
    first = got[got["dt"] > 1_000_000_000]
    assert len(first) and all(abs(c - round(math.cos(dt * 10.0 ** (-3 * i)), 5)) < 2e-5 for i in range(4) for dt, c in zip(first["dt"], first[f"c{i}"], strict=True))

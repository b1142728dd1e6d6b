"""Registered queries against their DuckDB counterparts on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.oracle_sql() if n[0] != "o" and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(tuple(str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    assert plain(got.select(columns).collect()) == plain(duck.sql(f"SELECT {names} FROM ({entry.oracle_sql()[name]})").fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_bars_of_zero_prices_match_sql(spark, tmp_path):
    """Prices that round to 0 open, close and bound bars; their percentages are null on both sides."""
    spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "ts", "user_id", "event_type", "CASE WHEN event_id % 3 = 0 THEN 0.001 ELSE value END AS value", "props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = entry.queries()["d11_close_bars"](spark, str(tmp_path))
    names = ", ".join(f'"{c}"' for c in got.columns)
    rows = got.collect()
    assert any(r.low == 0 for r in rows) and any(r.open == 0 for r in rows) and any(r.close == 0 for r in rows)
    assert plain(rows) == plain(con.sql(f"SELECT {names} FROM ({entry.oracle_sql()['d11_close_bars']})").fetchall())

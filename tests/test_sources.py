"""Stores and the sources that only need small tables."""

import pytest
from pyspark.sql import functions as F

from tapeloom.plans import views as v
from tapeloom.sources import stores
from tapeloom.sources.snapshots import SnapshotStore, missing_rows

SF = "/root/testdata/sf0.001"


def test_days_are_appended_once(spark, tmp_path):
    t, path = v.event_trades(spark, SF), f"{tmp_path}/trades"
    assert stores.read_store(spark, path) is None
    stores.append_trades(t, path)
    stores.append_trades(t, path)
    assert stores.read_store(spark, path).count() == t.count()
    symbol = t.first().symbol
    got = stores.scan_trades(spark, path, symbol, "2024-01-02", "2024-01-04")
    assert got.where("ts_ms < 1704153600000 OR ts_ms >= 1704412800000").count() == 0 and got.count() > 0
    assert "PartitionFilters" in got._jdf.queryExecution().toString()


def test_bars_replace_only_their_dates(spark, tmp_path):
    path = f"{tmp_path}/bars"
    bars = v.hourly_bars(spark, SF).drop("pq", "ppq")
    stores.write_bars(bars.where("bar_start < 1704326400000"), path, v.HOUR)
    stores.write_bars(bars, path, v.HOUR)
    assert stores.read_store(spark, path, "bars").count() == bars.count()


def test_run_zero_resets_the_manifest(spark):
    runs = spark.createDataFrame([(0, 100.0), (1, 200.0)], "run_id long, start_balance double")
    replaced = stores.upsert_manifest(runs, spark.createDataFrame([(1, 3.14159)], runs.schema))
    assert sorted(map(tuple, replaced.collect())) == [(0, 100.0), (1, 3.14)]
    reset = stores.upsert_manifest(runs, spark.createDataFrame([(0, 7.0)], runs.schema))
    assert list(map(tuple, reset.collect())) == [(0, 7.0)]


def test_spans_and_slices(spark):
    spans = spark.createDataFrame([("X", 60, "2024-01-01", "2024-01-31"), ("X", 60, "2024-01-02", "2024-01-10"), ("X", 60, "2024-01-05", "2024-01-06")], "symbol string, timeframe_ms int, start_date string, end_date string")
    spans = spans.withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})
    found = stores.find_bar_span(spans, "2024-01-03", "2024-01-09").collect()
    assert [str(r.start_date) for r in found] == ["2024-01-02"]
    assert stores.find_bar_span(spans, "2023-12-31", "2024-01-09").count() == 0
    bars = spark.createDataFrame([(0,), (86_400_000,), (86_400_001,)], "open_time long")
    assert stores.slice_bars(bars, 0, 0).count() == 2


def test_equity_padding_goes(spark):
    e = spark.createDataFrame([(1, 0, 0, 0, 0, 0), (1, 5, 10**8, 10**8, 10**8, 2 * 10**8)], "run_id long, ts_ms long, open long, high long, low long, close long")
    assert [r.close for r in stores.scale_equity(e).collect()] == [2.0]


TRADES = "symbol string, trade_id long, ts_ms long, n_qty long"


def held(spark, path, version=None):
    rows = SnapshotStore(spark, path).read("trades", version)
    return sorted((r.symbol, r.trade_id) for r in rows.collect())


def test_part_days_are_completed_and_nothing_is_repeated(spark, tmp_path):
    path = f"{tmp_path}/trades"
    rows = [("X", i, i * 3_600_000, i) for i in range(60)]
    assert stores.append_trades(spark.createDataFrame(rows[:10] + rows[5:13], TRADES), path) == 1
    assert stores.append_trades(spark.createDataFrame(rows[8:40], TRADES), path) == 2
    stores.append_trades(spark.createDataFrame(rows[:5] + [("Y", 1, 1, 1)], TRADES), path)
    assert held(spark, path) == [("X", i) for i in range(40)] + [("Y", 1)]
    assert held(spark, path, 1) == [("X", i) for i in range(13)]  # an older snapshot still stands
    stores.append_trades(spark.createDataFrame([], TRADES), path)
    assert len(held(spark, path)) == 41


def test_an_interrupted_append_leaves_no_trace_and_can_be_repeated(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/trades"
    stores.append_trades(spark.createDataFrame([("X", 1, 1, 1)], TRADES), path)
    more = spark.createDataFrame([("X", 1, 1, 1), ("X", 2, 2, 1), ("Z", 3, 3, 1)], TRADES)

    def dies(self, version, text):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(SnapshotStore, "_publish", dies)
        stores.append_trades(more, path)
    assert held(spark, path) == [("X", 1)]
    stores.append_trades(more, path)
    assert held(spark, path) == [("X", 1), ("X", 2), ("Z", 3)]


def test_writers_that_meet_lose_and_repeat_nothing(spark, tmp_path):
    path, store = f"{tmp_path}/trades", SnapshotStore(spark, f"{tmp_path}/trades")
    stores.append_trades(spark.createDataFrame([("X", 1, 1, 1)], TRADES), path)
    mine = spark.createDataFrame([("X", i, i, 1) for i in (1, 2, 3)], TRADES).withColumn("trade_date", F.lit("1970-01-01").cast("date"))
    tries = []

    def made(read):
        rows = missing_rows(mine, read("trades"), ["symbol", "trade_date"], ["trade_id"]).cache()
        tries.append(rows.count())
        if len(tries) == 1:  # another writer comes first
            stores.append_trades(spark.createDataFrame([("X", 2, 2, 1), ("X", 9, 9, 1)], TRADES), path)
        return {"trades": rows}

    assert store.commit(made, {"trades": ["symbol", "trade_date"]}) == 3
    assert tries == [2, 1] and held(spark, path) == [("X", 1), ("X", 2), ("X", 3), ("X", 9)]
    assert store._publish(2, "{}") is False  # a number that is taken stays as it is
    assert held(spark, path, 2) == [("X", 1), ("X", 2), ("X", 9)]
    with pytest.raises(RuntimeError, match="came first"):
        store.commit(lambda read: {"trades": (stores.append_trades(spark.createDataFrame([("X", 100 + store.version(), 1, 1)], TRADES), path), mine)[1]}, {"trades": ["symbol", "trade_date"]}, attempts=2)


def test_a_run_is_read_as_last_written_and_both_tables_together(spark, tmp_path):
    path = f"{tmp_path}/runs"
    fills = lambda *rows: spark.createDataFrame(rows, "run_id long, seq long")
    equity = lambda *rows: spark.createDataFrame(rows, "run_id long, ts_ms long")
    stores.write_run(fills((1, 1), (1, 2), (2, 1)), equity((1, 5), (2, 5)), path)
    assert stores.write_run(fills((1, 7)), equity((1, 8), (1, 9)), path) == 2
    assert sorted(map(tuple, stores.read_run_table(spark, path, "fills").select("run_id", "seq").collect())) == [(1, 7), (2, 1)]
    assert sorted(map(tuple, stores.read_run_table(spark, path, "equity").select("run_id", "ts_ms").collect())) == [(1, 8), (1, 9), (2, 5)]


def test_the_manifest_is_replaced_as_a_whole(spark, tmp_path):
    runs = spark.createDataFrame([(1, 1.005), (2, 2.0)], "run_id long, start_balance double")
    path = f"{tmp_path}/m"
    stores.commit_manifest(runs, path)
    stores.commit_manifest(spark.createDataFrame([(2, 5.0), (3, 6.0)], runs.schema), path)
    assert sorted(map(tuple, stores.read_store(spark, path, "manifest").collect())) == [(1, 1.0), (2, 5.0), (3, 6.0)]
    stores.commit_manifest(spark.createDataFrame([(0, 9.0)], runs.schema), path)
    assert list(map(tuple, stores.read_store(spark, path, "manifest").collect())) == [(0, 9.0)]

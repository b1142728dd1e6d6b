"""Streams on files give what the batch operators give."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tapeloom.operators.cells import bars_ohlcv
from tapeloom.plans import bars as plan
from tapeloom.plans import views as v
from tapeloom.sources import decoders as dec
from tapeloom.streaming import accounts as acc
from tapeloom.streaming import trades as st

SF = "/root/testdata/sf0.001"


def stream_of(spark, df, path, files=1):
    df.coalesce(files).write.parquet(path)
    return st.read_trade_files(spark, path, df.schema, 1)


def timed(df):
    return df.withColumn("ts", F.timestamp_millis("ts_ms"))


def test_bars_of_a_stream_are_the_batch_bars(spark, tmp_path):
    trades = timed(v.event_trades(spark, SF))
    s = stream_of(spark, trades.orderBy("ts_ms"), f"{tmp_path}/t")
    st.run_available(st.stream_bars(s, v.HOUR), "live_bars", "complete")
    names = ["symbol", "bar_start", "open", "high", "low", "close", "volume", "delta", "n_trades", "open_time", "last_trade_time"]
    want = bars_ohlcv(trades, v.HOUR).select(names)
    got = spark.table("live_bars").select(names)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_cells_of_a_stream(spark, tmp_path):
    s = stream_of(spark, timed(v.event_trades(spark, SF)), f"{tmp_path}/c")
    st.run_available(st.stream_cells(s, v.HOUR, v.SCALE), "live_cells", "complete")
    assert spark.table("live_cells").agg(F.sum(F.col("bid_qty") + F.col("ask_qty"))).first()[0] == v.event_trades(spark, SF).agg(F.sum("n_qty")).first()[0]


def test_ids_are_used_once(spark, tmp_path):
    trades = timed(v.event_trades(spark, SF).limit(40))
    s = stream_of(spark, trades.union(trades), f"{tmp_path}/d")
    st.run_available(st.dedupe_trades(s, "60 days"), "once")
    assert spark.table("once").count() == trades.count()


def test_gaps_in_batch_and_stream(spark, tmp_path):
    ids = spark.createDataFrame([("X", i, i * 1000) for i in (1, 2, 5, 6, 90000)] + [("Y", 1, 1), ("Y", 2, 86_400_000 * 3), ("Y", 4, 86_400_000 * 4)], "symbol string, trade_id long, ts_ms long")
    want = {("X", 2, 5, 2), ("X", 6, 90000, 89993), ("Y", 2, 4, 1)}
    assert {tuple(r) for r in st.trade_gaps(ids).collect()} == want
    assert [r.after_id for r in st.gap_limit_alert(st.trade_gaps(ids)).collect()] == [6]
    requests = st.gap_requests(st.trade_gaps(ids).where("symbol = 'X' AND after_id = 6"), 1000).orderBy("from_id").collect()
    assert requests[0].from_id == 6 and requests[-1].to_id == 90000 and all(a.to_id == b.from_id for a, b in zip(requests, requests[1:], strict=False))


def test_gaps_of_a_stream_are_reported_split_and_taken_back(spark, tmp_path):
    schema = "symbol string, trade_id long, ts_ms long"
    minute = 60_000
    steps = [
        [("X", i, minute) for i in (1, 2, 9, 10, 20)] + [("Y", 5, minute), ("Y", 7, minute)],  # gaps 2-9, 10-20 and 5-7, too young to tell
        [("Y", 6, minute + 1)],  # closed before anybody heard of it
        [(None, None, 3 * minute)],
        [("X", 5, 4 * minute), ("X", 11, 4 * minute), ("X", 15, 4 * minute), ("X", 15, 4 * minute), ("X", 21, 4 * minute)],  # split: 2-5, 5-9; shrunk and split: 11-15, 15-20
        [("X", i, 5 * minute) for i in (3, 4, 0)] + [("X", 30, 5 * minute)],  # 2-5 closes, and 21-30 opens
        [(None, None, 9 * minute)],
    ]
    want = [
        set(), set(), {(2, 9, 1), (10, 20, 1)}, {(2, 9, -1), (10, 20, -1), (2, 5, 1), (5, 9, 1), (11, 15, 1), (15, 20, 1)}, {(2, 5, -1)}, {(21, 30, 1)},
    ]
    for step, expected in zip(steps, want, strict=True):
        timed(spark.createDataFrame(step, schema)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ids")
        s = st.read_trade_files(spark, f"{tmp_path}/ids", timed(spark.createDataFrame([], schema)).schema)
        got = []
        st.run_available(st.stream_gaps(s, 60_000), "", "append", f"{tmp_path}/state", lambda df, i, got=got: got.extend(df.collect()))
        assert {(r.after_id, r.before_id, r.change) for r in got} == expected and len(got) == len(expected)
        assert all(r.missing == r.before_id - r.after_id - 1 and r.symbol == "X" for r in got)


def test_merged_ranges_hold_all_ids():
    rng = np.random.default_rng(3)
    for _ in range(200):
        ids = [np.unique(rng.integers(-20, 40, rng.integers(1, 25))) for _ in range(3)]
        known = {}
        for x in ids:
            known = st.merged_ranges(known, x)
        assert [i for a, b in known.items() for i in range(a, b + 1)] == sorted({*map(int, np.concatenate(ids))})
        assert all(b + 1 < a for (_, b), (a, _) in zip(list(known.items()), list(known.items())[1:], strict=False))


def test_signals_and_lag(spark, tmp_path):
    sig = spark.createDataFrame([("X", 1000), ("X", 2000), ("X", 90_000)], "symbol string, ts_ms long")
    assert [r.ts_ms for r in st.lag_filter(sig, F.lit(100_000)).collect()] == [90_000]
    assert [(r.symbol, r.n) for r in st.lag_warnings(sig, F.lit(100_000)).collect()] == [("X", 2)]
    bars = bars_ohlcv(v.event_trades(spark, SF), v.HOUR).select("symbol", "bar_start", "close", "delta")
    bars.coalesce(1).write.parquet(f"{tmp_path}/s")
    s = spark.readStream.schema(bars.schema).parquet(f"{tmp_path}/s")
    st.run_available(st.stream_signals(s, F.col("delta") > 0, ["symbol", "close"]), "live_signals")
    assert spark.table("live_signals").count() == bars.where("delta > 0").count()


def test_messages_that_do_not_decode_are_set_apart(spark):
    rows = [('{"p":"1.5","q":"2","T":5,"m":true,"a":9}',), ('[{"p":"1","q":"1","T":1,"m":false,"a":1},{"p":"2","q":"2","T":2,"m":true,"a":2}]',), ('{"p":"1.5"',), ("[]",), (None,), ('{"p":"1"}',)]
    df = spark.createDataFrame(rows, "message string")
    good, bad = dec.split_bad_messages(df, "object")
    assert (good.count(), bad.count()) == (2, 4)
    got = dec.scale_trades(dec.decode_agg_trades(df, "object"), 100, 10).orderBy("agg_id").collect()
    assert [(r.n_price, r.n_qty, r.is_sell) for r in got] == [(100, 10, False), (200, 20, True), (150, 20, True)]
    modes = spark.createDataFrame([("0.29", "1")], "price string, qty string")
    assert [dec.scale_trades(modes, 100, 1, m).first().n_price for m in ("exact", "trunc", "round")] == [29, 28, 29]
    dec.register_decoder("mine", dec.TradeDecoder("array(from_json(message, 'struct<x:string>'))", "t.x", "t.x", "1L", "true", "2L"))
    assert dec.decode_agg_trades(spark.createDataFrame([('{"x":"7"}',)], "message string"), "mine").first().price == "7"


def test_the_bar_table_of_a_stream_is_the_batch_table(spark, tmp_path):
    t = v.event_trades(spark, SF)
    bars = st.with_profiles(bars_ohlcv(t, v.HOUR), plan.c.footprint_cells(t, v.HOUR, v.SCALE)).cache()
    cut = [1_706_000_000_000, 1_710_000_000_000]
    for n, part in enumerate((bars.where(f"bar_start < {cut[0]}"), bars.where(f"bar_start >= {cut[0]} AND bar_start < {cut[1]}"), bars.where(f"bar_start >= {cut[1]}"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/b")
        s = spark.readStream.schema(bars.schema).parquet(f"{tmp_path}/b")
        st.run_available(st.stream_close_bars(s, v.HOUR, v.SCALE, v.BAR_COUNT), "", "append", f"{tmp_path}/cs", lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out"))
    want = plan.close_bars(t, v.HOUR, v.SCALE, v.BAR_COUNT)
    got = spark.read.parquet(f"{tmp_path}/out").select(want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_a_backfill_fills_the_gaps_once(spark, tmp_path):
    t = timed(v.event_trades(spark, SF)).select("symbol", "trade_id", "ts", "ts_ms", "n_price", "n_qty", "is_sell")
    live = stream_of(spark, t.where("trade_id % 5 <> 2"), f"{tmp_path}/live", 2)
    late = stream_of(spark, t.where("trade_id % 5 IN (1, 2)"), f"{tmp_path}/late", 2)
    st.run_available(st.merge_backfill(live, late, "400 days"), "merged", "append", f"{tmp_path}/ms")
    got = spark.table("merged").select(t.columns)
    assert got.count() == t.count() and got.exceptAll(t).count() == 0


def heartbeat(trades, spark):
    """One row without a symbol, long after all trades."""
    return spark.createDataFrame([(None, None, 4_000_000_000_000, None, None, None)], trades.drop("ts").schema).withColumn("ts", F.timestamp_millis("ts_ms"))


def in_slices(df, path, cuts):
    """Files in time order, each written after the one before."""
    edges = [0, *cuts, 5_000_000_000_000]
    for a, b in zip(edges, edges[1:], strict=False):
        df.where(f"ts_ms >= {a} AND ts_ms < {b}").coalesce(1).write.mode("append").parquet(path)


def test_trades_to_signals_in_one_stream(spark, tmp_path):
    t = v.event_trades(spark, SF)
    timed_ = timed(t.union(heartbeat(timed(t), spark).drop("ts")))
    in_slices(timed_, f"{tmp_path}/t", [1_704_600_000_000, 1_705_500_000_000, 1_706_500_000_000])
    s = st.read_trade_files(spark, f"{tmp_path}/t", timed_.schema, 1)
    closed = st.stream_close_bars(st.stream_profiled_bars(s, v.HOUR, v.SCALE, "2 hours"), v.HOUR, v.SCALE, v.BAR_COUNT)
    triggers = []

    def keep(df, i):
        triggers.append(i)
        df.write.mode("append").parquet(f"{tmp_path}/out")

    st.run_available(closed, "", "append", f"{tmp_path}/cs", keep)
    want = plan.close_bars(t, v.HOUR, v.SCALE, v.BAR_COUNT)
    got = spark.read.parquet(f"{tmp_path}/out").select(want.columns)
    assert len(triggers) >= 4
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_bars_out_of_order_stop_the_stream(spark, tmp_path):
    t = v.event_trades(spark, SF)
    bars = st.with_profiles(bars_ohlcv(t, v.HOUR), plan.c.footprint_cells(t, v.HOUR, v.SCALE)).cache()
    for part in ("bar_start >= 1706000000000", "bar_start < 1706000000000"):
        bars.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/b")
    s = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/b")
    with pytest.raises(StreamingQueryException, match="came after bar"):
        st.run_available(st.stream_close_bars(s, v.HOUR, v.SCALE, v.BAR_COUNT), "late_bars", "append", f"{tmp_path}/cs")


def test_positions_of_a_stream_in_any_order(spark, tmp_path):
    long, short, buy, sell, new, filled, gone = 1, 2, 4, 8, 128, 512, 1024
    schema = "account string, symbol string, order_param long, order_id long, n_price long, n_qty long, ts_ms long, seq long"
    event = lambda account, param, ts, seq, order=1: (account, "X", param, order, 5, 6, ts, seq)
    minute = 60_000
    steps = [
        [event("a", long | buy | new, minute, 1), event("b", short | sell | filled, 2 * minute, 9), event("c", long | sell | new, minute, 1), event("d", long | buy | new, minute, 1)],
        [event("b", short | sell | new, minute, 3), event("d", long | buy | filled, minute, 2), event("e", 16, minute, 1)],  # older than what is known; the same time, later; no side
        [(None, None, None, None, None, None, 30 * minute, None)],
        [event("a", long | buy | filled, 31 * minute, 7, 2), event("b", short | buy | gone, 31 * minute, 8)],
    ]
    want = [
        {("a", "LONG", "PENDING", False), ("b", "SHORT", "OPEN", False), ("c", "LONG", "CLOSE", False), ("d", "LONG", "PENDING", False)}, {("d", "LONG", "OPEN", False)},
        {("a", "LONG", "EMPTY", True), ("c", "LONG", "OPEN", True)}, {("a", "LONG", "OPEN", False), ("b", "SHORT", "OPEN", False)},
    ]
    seen = []
    for step, expected in zip(steps, want, strict=True):
        part = timed(spark.createDataFrame(step, schema))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        got = []
        s = st.read_trade_files(spark, f"{tmp_path}/e", part.schema)
        st.run_available(acc.stream_positions(s, 10 * minute, "15 minutes"), "", "append", f"{tmp_path}/state", lambda df, i, got=got: got.extend(df.collect()))
        assert {(r.account, r.side, r.state, r.lapsed) for r in got} == expected
        seen += got
    now = acc.positions_now(spark.createDataFrame(seen))
    assert {(r.account, r.state, r.order_id) for r in now.collect()} == {("a", "OPEN", 2), ("b", "OPEN", 1), ("c", "OPEN", 1), ("d", "OPEN", 1)}


def test_tasks_send_the_latest_event_of_each_side(monkeypatch):
    """Many events of few sides come down to one row a side and the greatest time; with more sides than a task holds, every latest event still goes on."""
    rng = np.random.default_rng(5)
    for held, accounts in ((1 << 17, 3), (20, 40)):
        monkeypatch.setattr(acc, "HELD_EVENTS", held)
        rows = [(None if a == 0 else str(a), "XY"[s], None if d == 2 else ("LONG", "SHORT")[d], int(t), int(q), int(t) * 1000) for a, s, d, t, q in zip(*(rng.integers(0, n, 600) for n in (accounts, 2, 3, 50, 9)), strict=True)]
        names = ["account", "symbol", "side", "ts_ms", "seq", "ts"]
        table = pa.table([list(c) for c in zip(*rows, strict=True)], names=names).set_column(5, "ts", pa.array([r[5] for r in rows], pa.timestamp("us", "UTC")))
        got = pa.Table.from_batches(acc.latest_events(iter(table.to_batches(max_chunksize=50)))).to_pylist()
        want = {}
        for a, s, d, t, q, _ in rows:
            if a and d:
                want[a, s, d] = max(want.get((a, s, d), (-1, -1)), (t, q))
        best = {}
        for r in got:
            if r["account"]:
                key = (r["account"], r["symbol"], r["side"])
                best[key] = max(best.get(key, (-1, -1)), (r["ts_ms"], r["seq"]))
        assert best == want and max(r["ts"] for r in got if not r["account"]) == max(r["ts"] for r in table.to_pylist())
        assert held < 100 or len(got) == len(want) + 1


def test_runs_cut_gaps_as_sets_of_ids_do():
    rng = np.random.default_rng(7)
    for _ in range(300):
        first = rng.integers(-20, 60, rng.integers(1, 9))
        last = first + rng.integers(0, 6, len(first))
        seen = {i for a, b in zip(first.tolist(), last.tolist(), strict=True) for i in range(a, b + 1)}
        first, last = st.merged_runs(first, last)
        assert {i for a, b in zip(first.tolist(), last.tolist(), strict=True) for i in range(a, b + 1)} == seen and (first[1:] > last[:-1] + 1).all()
        edges = np.cumsum(rng.integers(1, 9, 10)) - 20
        gaps = np.array([(a, b, 0, 0) for a, b in zip(edges[:-1:2].tolist(), edges[1::2].tolist(), strict=True) if b - a > 1], np.int64).reshape(-1, 4)
        left, source, cut = st.without_runs(gaps, first, last)
        assert [bool(set(range(a + 1, b)) & seen) for a, b, *_ in gaps.tolist()] == cut.tolist()
        for i, (a, b, *_) in enumerate(gaps.tolist()):
            pieces = left[source == i].tolist()
            assert [x for p in pieces for x in range(p[0] + 1, p[1])] == [x for x in range(a + 1, b) if x not in seen]
            assert all({p[0], p[1]} <= seen | {a, b} for p in pieces)


def test_gaps_of_a_stream_across_blocks(spark, tmp_path):
    """Gaps that start in one block of ids and end in another, an id far away and ids before the first, against sets of ids in a plain version."""
    schema, minute, far = "symbol string, trade_id long, ts_ms long", 60_000, 10 * st.GAP_BLOCK
    edge = st.GAP_BLOCK
    steps = [[edge - 9, edge - 3, edge + 5, far, far + 2], [edge - 1, edge + 1, edge + 2, 3 * edge], [2, edge, far + 1, far + 9, 3 * edge + 1, 3 * edge - 5], [edge - 2, -edge, 7 * edge]]
    seen, open_ = set(), set()
    for n, ids in enumerate(steps):
        rows = [[("X", i, (4 * n + 1) * minute) for i in ids], [(None, None, (4 * n + 3) * minute)]]
        for part in rows:
            timed(spark.createDataFrame(part, schema)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ids")
            s = st.read_trade_files(spark, f"{tmp_path}/ids", timed(spark.createDataFrame([], schema)).schema)
            st.run_available(st.stream_gaps(s, minute), "", "append", f"{tmp_path}/state", lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out"))
        seen |= set(ids)
        order = sorted(seen)
        open_ = {(a, b) for a, b in zip(order, order[1:], strict=False) if b - a > 1}
        got = st.open_gaps(spark.read.parquet(f"{tmp_path}/out")).collect()
        assert {(r.after_id, r.before_id) for r in got} == open_ and len(got) == len(open_)


def test_tasks_send_runs_of_ids(spark):
    ids = spark.createDataFrame([("X", i, 60_000 + i) for i in range(5000) if i % 97 > 2] + [("X", 7, 1), (None, None, 90_000)], "symbol string, trade_id long, ts_ms long").coalesce(1)
    got = timed(ids).select("symbol", "trade_id", "ts").mapInArrow(st.id_runs, "symbol string, first_id long, last_id long, _at timestamp").collect()
    runs = [r for r in got if r.symbol]
    assert [i for r in runs for i in range(r.first_id, r.last_id + 1)] == [i for i in range(5000) if i % 97 > 2] and len(runs) == 52
    assert [r._at.timestamp() for r in got if not r.symbol] == [90] and {r._at.timestamp() for r in runs} == {64.999}

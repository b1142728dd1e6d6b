"""Ledger and statistics against a plain model, parameter sweeps, and gates."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from tapeloom.functions.scalars import MONEY
from tapeloom.operators import ledger as led
from tapeloom.operators import lifecycle as life
from tapeloom.operators import outcomes as out
from tapeloom.operators import resample as res

FILL = "run_id long, seq long, symbol string, ts_ms long, n_price long, n_qty long, order_param long, n_commission long, n_mae long, n_mfe long, planned_tp long, planned_sl long"
PNLS = [10, -5, 0, 7, -3, 8]


@pytest.fixture(scope="module")
def run(spark):
    rows, seq = [], 0
    for i, p in enumerate(PNLS):
        for price, flags in ((10_000, 1 | 4 | 32 | 512), (10_000 + p * 100, 1 | 8 | 32 | 512)):
            seq += 1
            rows.append((1, seq, "X", 60_000 * (seq + i), price, 1000, flags, 0, -100, 200, 500, 300))
    rows.append((1, 99, "X", 0, 1, 1, 1 | 4 | 32 | 1024, 5, 0, 0, 0, 0))
    fills = spark.createDataFrame(rows, FILL)
    runs = spark.createDataFrame([(1, 1000.0, "2024-01-01", "2024-01-03", 3_600_000)], "run_id long, start_balance double, start_date string, end_date string, timeframe_ms long")
    equity = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 0.0)] + [(1, i + 1, x, x + 2, x - 2, x) for i, x in enumerate((1000.0, 1010.0, 990.0, 1020.0))], "run_id long, ts_ms long, open double, high double, low double, close double")
    return fills, equity, runs


def test_statistics(run):
    fills, equity, runs = run
    r = led.run_stats(fills, equity, runs).first()
    wins, losses = [p for p in PNLS if p > 0], [p for p in PNLS if p <= 0]
    assert (r.n_closed, r.n_win, r.n_loss, r.sum_win, r.sum_loss) == (6, 3, 3, sum(wins), sum(losses))
    assert r.win_rate == 50 and math.isclose(r.avg_win, 25 / 3) and math.isclose(r.avg_loss, -8 / 3)
    assert math.isclose(r.expectancy, 2.8333333333) and math.isclose(r.payoff_ratio, 3.125) and math.isclose(r.kelly_pct, 34)
    assert math.isclose(r.sqn, math.sqrt(6) * statistics.mean(PNLS) / statistics.stdev(PNLS))
    assert (r.max_win_streak, r.max_loss_streak) == (1, 1)
    assert r.static_dd_val == 5 and math.isclose(r.static_dd_pct, 5 / 1010 * 100)
    assert r.net_profit == sum(PNLS) and r.end_balance == 1000 + sum(PNLS) and r.long_count == 6 and r.short_count == 0
    returns = [1010 / 1000 - 1, 990 / 1010 - 1, 1020 / 990 - 1]
    year = math.sqrt(365 * 24)
    assert math.isclose(r.sharpe, statistics.mean(returns) / statistics.stdev(returns) * year)
    assert math.isclose(r.sortino, statistics.mean(returns) / abs(returns[1]) * year)
    assert math.isclose(r.dynamic_dd_pct, 24 / 1012 * 100) and math.isclose(r.recovery_factor, sum(PNLS) / 24)
    assert math.isclose(r.calmar, sum(PNLS) / 1000 * 365 / 3 * 100 / r.static_dd_pct) and r.avg_hold_minutes == 1


def test_profit_factor(spark):
    at = lambda w, l, f: spark.range(1).select(led.profit_factor(F.lit(w), F.lit(l), F.lit(f)).alias("x")).first().x  # noqa: E731, E741
    assert at(25.0, -8.0, 2.0) == 2.5 and at(25.0, 0.0, 0.0) == 25.0 and at(0.0, 0.0, 0.0) == 1.0


def test_averaged_entries_and_hedging(spark):
    long_, short = 1 | 512 | 32, 2 | 512 | 32
    rows = [(1, 1, 100, 3, long_ | 4), (1, 2, 105, 2, long_ | 4), (1, 3, 90, 4, short | 8), (1, 4, 110, 5, long_ | 8), (1, 5, 80, 4, short | 4)]
    fills = spark.createDataFrame([(r, q, "X", q, p, n, f, 0, 0, 0, 0, 0) for r, q, p, n, f in rows], FILL)
    runs = spark.createDataFrame([(1, 10.0)], "run_id long, start_balance double")
    got = {r.seq: (r.n_entry, r.n_pnl) for r in led.position_ledger(fills, runs, 1, 1).collect()}
    assert got == {1: (0, 0), 2: (100, 0), 3: (0, 0), 4: (102, 8 * 5 * MONEY), 5: (90, 10 * 4 * MONEY)}


def test_streaks_end_at_zero(spark):
    closed = spark.createDataFrame([(1, i, float(p)) for i, p in enumerate((1, 2, 0, 3, -1, -1, -1, 4))], "run_id long, seq long, pnl double")
    assert tuple(led.streaks(closed).first()) == (1, 2, 3)


def test_runs_take_the_last_of_shorter_lists(spark):
    lists = spark.createDataFrame([("g", [1, 2, 3], [7])], "name string, a array<int>, b array<int>")
    assert [tuple(r) for r in out.expand_runs(lists, ["a", "b"]).orderBy("run_no").collect()] == [("g", 0, 1, 7), ("g", 1, 2, 7), ("g", 2, 3, 7)]
    grid = out.date_grid(spark.createDataFrame([("2024-01-30",)], "d string").withColumn("d", F.col("d").cast("date")), "d", 2, 3, False)
    assert [r.date for r in grid.orderBy("date_no").collect()] == ["2024-02-01", "2024-02-03", "2024-02-05"]


CANDIDATE = "run_id long, order_id string, symbol string, is_long boolean, ts_ms long, end_ts long"


def test_one_position_per_side(spark):
    rows = [(1, "a", "X", True, 10, 30), (1, "b", "X", True, 20, 25), (1, "c", "X", False, 20, 22), (1, "d", "X", True, 30, 50), (1, "e", "X", True, 31, None), (1, "f", "X", True, 99, 120)]
    assert sorted(r.order_id for r in out.one_position_per_side(spark.createDataFrame(rows, CANDIDATE)).collect()) == ["a", "c", "e"]


def test_runs_stop_at_the_loss_limit(spark):
    schema = "run_id long, order_id string, symbol string, is_long boolean, fill_ts long, fill_price long, exit_ts long, exit_price long, exit_is_maker boolean"
    rows = [(1, f"o{i}", "X", True, i * 10, 10_000, i * 10 + 5, 2_000 if i == 1 else 10_100, True) for i in range(4)]
    got = out.size_and_gate(spark.createDataFrame(rows, schema)).orderBy("fill_ts").collect()
    assert [r.order_id for r in got] == ["o0", "o1"] and got[0].pnl > 0 > got[1].pnl
    refused = out.size_and_gate(spark.createDataFrame(rows, schema), policy=lambda r, size: None if r.order_id == "o0" else size)
    assert [r.order_id for r in refused.orderBy("fill_ts").collect()] == ["o1"]


def test_cancels_take_latency(spark):
    touched = spark.createDataFrame([("a", 500), ("b", 200), ("c", None), ("d", 300)], "order_id string, touch_ts long")
    cancels = spark.createDataFrame([("a", 300), ("b", 150), ("c", 1), ("d", 200)], "order_id string, cancel_ts long")
    assert sorted(r.order_id for r in out.cancel_effective(touched, cancels).collect()) == ["b"]


def test_pyramid_stops_at_the_first_short_enough(spark):
    bars = spark.range(400).select(F.lit("X").alias("symbol"), (F.col("id") * 3_600_000).alias("ts_ms"), *[(F.col("id") + i).alias(n) for i, n in enumerate(("open", "high", "low", "close"))])
    assert sorted(r.step for r in res.timeframe_pyramid(bars, 3_600_000).select("step").distinct().collect()) == [3_600_000, 14_400_000]


def test_fills_and_touches_match_a_walk_over_trades(spark):
    import random

    rng = random.Random(4)
    trades = sorted((rng.choice("AB"), rng.randrange(0, 40_000_000) // 1000 * 1000, i, rng.randrange(90, 110)) for i in range(300))
    orders = [(f"o{i}", rng.choice("ABC"), rng.randrange(-10_000, 41_000_000), rng.random() < 0.5, rng.random() < 0.5, rng.randrange(88, 112)) for i in range(120)]
    t = spark.createDataFrame([(s, i, ts, px) for s, ts, i, px in trades], "symbol string, trade_id long, ts_ms long, n_price long")
    asked = spark.createDataFrame(orders, "order_id string, symbol string, ts_ms long, is_buy boolean, is_stop boolean, n_price long")
    for block in (4096, 2):
        got = {r.order_id: (r.fill_ts, r.fill_id) for r in out.entry_fill(asked, t, 60_000, latency=100, slip_bps=0, block=block).collect()}
        for o, s, ts, *_ in orders:
            first = min(((a, i) for x, a, i, _ in trades if x == s and a >= ts + 100), default=(None, None))
            assert got[o] == first
    bars = t.groupBy("symbol", F.expr("ts_ms - pmod(ts_ms, 60000)").alias("bar_start")).agg(F.max("n_price").alias("high"), F.min("n_price").alias("low"), F.count(F.lit(1)).alias("n_trades"))
    for fan in (60, 7):
        got = {r.order_id: (r.touch_ts, r.touch_id) for r in out.first_touch(asked.withColumnRenamed("ts_ms", "active_ts"), t, bars, 60_000, 0, fan).collect()}
        for o, s, ts, buy, stop, px in orders:
            meets = (lambda p: p >= px) if buy == stop else (lambda p: p <= px)  # noqa: B023
            assert got[o] == min(((a, i) for x, a, i, p in trades if x == s and a >= ts and meets(p)), default=(None, None))


class LimitFirst:
    """Enters by a limit below the signal; a limit that is cancelled at its end is followed by a market order; brackets as usual, and no second entry."""

    def on_signal(self, signals):
        chain = F.col("order_id")
        return signals.withColumns({"chain": chain, "step": F.lit(0), "order_id": F.concat(chain, F.lit("/limit")), "is_buy": F.col("is_long"), "kind": F.lit("limit"), "n_price": F.lit(95), "until": F.col("ts_ms") + 50_000})

    def on_fill(self, fills):
        entered = fills.withColumn("kind", F.when(F.col("oco").isNull(), "market").otherwise(F.col("kind")))
        return life.Bracket().on_fill(entered)

    def on_cancel(self, cancels):
        late = cancels.where("oco IS NULL")
        return late.withColumns({"order_id": F.concat("chain", F.lit("/market")), "kind": F.lit("market"), "n_price": F.lit(None), "until": F.lit(None), "ts_ms": F.col("event_ts")})


def market(spark, prices):
    trades = spark.createDataFrame([("X", i, i * 10_000, p) for i, p in enumerate(prices)], "symbol string, trade_id long, ts_ms long, n_price long")
    bars = trades.groupBy("symbol", F.expr("ts_ms - pmod(ts_ms, 60000)").alias("bar_start")).agg(F.max("n_price").alias("high"), F.min("n_price").alias("low"), F.count(F.lit(1)).alias("n_trades"))
    return trades, bars


def test_hooks_answer_fills_and_cancels(spark):
    trades, bars = market(spark, [100, 101, 99, 98, 97, 96, 100, 94, 100, 106, 120, 90, 80, 130])
    signals = spark.createDataFrame([("a", "X", 0, True, 1000, 1000), ("b", "X", 30_000, True, 1000, 1000)], "order_id string, symbol string, ts_ms long, is_long boolean, tp_bps long, sl_bps long")
    done = life.run_orders(signals, trades, bars, 60_000, LimitFirst(), slip_bps=0)
    got = {r.order_id: (r.status, r.event_ts, r.fill_price) for r in done.collect()}
    assert got == {
        "a/limit": ("cancelled", 50_100, None), "a/market": ("filled", 60_000, 100), "a/market:tp": ("filled", 100_000, 110), "a/market:sl": ("cancelled", 100_000, None),
        "b/limit": ("filled", 70_000, 95), "b/limit:tp": ("filled", 90_000, 104), "b/limit:sl": ("cancelled", 90_000, None),
    }


def test_a_stop_is_followed_by_so_many_entries(spark):
    trades, bars = market(spark, [100, 100, 80, 100, 100, 80, 100, 100, 80, 80])
    signals = spark.createDataFrame([("a", "X", 0, True, 1000, 1000), ("s", "X", 0, False, 1000, 1000), ("none", "Y", 0, True, 1, 1)], "order_id string, symbol string, ts_ms long, is_long boolean, tp_bps long, sl_bps long")
    for most, want in ((0, 1), (1, 2), (9, 4)):
        done = life.run_orders(signals, trades, bars, 60_000, life.Bracket(most), slip_bps=0)
        trips = sorted((r.step, r.fill_ts, r.exit_leg, r.exit_ts) for r in life.round_trips(done).collect() if r.chain == "a")
        assert len(trips) == want and trips[0] == (0, 10_000, "sl", 20_000)
        assert [r.exit_leg for r in life.round_trips(done).collect() if r.chain == "s"] == ["tp"]
        assert {r.status for r in done.collect() if r.chain == "none"} == {"open"}


def test_a_policy_that_never_ends_is_an_error(spark):
    trades, bars = market(spark, [100, 80] * 8)
    signals = spark.createDataFrame([("a", "X", 0, True, 9000, 1)], "order_id string, symbol string, ts_ms long, is_long boolean, tp_bps long, sl_bps long")
    with pytest.raises(RuntimeError, match="did not end"):
        life.run_orders(signals, trades, bars, 60_000, life.Bracket(10**6), slip_bps=0, most_rounds=3)
    assert life.run_orders(signals.where("false"), trades, bars, 60_000).count() == 0

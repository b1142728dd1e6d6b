"""The worked example of bars, indicators and flags, and properties on the derived trades."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.scalars import flag_names
from tapeloom.operators import cells as c
from tapeloom.operators import indicators as ind
from tapeloom.plans import bars as plan
from tapeloom.plans import views as v

TRADES = [(1, 0, 10000, 30, False), (2, 10000, 10003, 20, True), (3, 20000, 10012, 50, False), (4, 59999, 10007, 10, True), (5, 60000, 10007, 40, True), (6, 70000, 9996, 70, True), (7, 90000, 9991, 20, False), (8, 240000, 10020, 60, False)]
TRADE = "symbol string, trade_id long, ts_ms long, n_price long, n_qty long, is_sell boolean"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trades(spark):
    rows = [("X", *t) for t in TRADES]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, TRADE)


def test_full_bars(trades):
    got = plan.close_bars(trades, 60_000, 5, 1440).orderBy("bar_start").collect()
    rows = [(r.open, r.high, r.low, r.close, r.volume, r.delta, r.cvd, r.n_trades, r.vwap, r.vwap_up, r.vwap_low, r.poc, r.vah, r.val, r.session_poc, r.session_vah, r.session_val, r.atr, r.parkinson) for r in got]
    assert rows == [
        (10000, 10012, 10000, 10007, 110, 50, 50, 4, 10007, 10017, 9996, 10015, 10015, 10005, 10015, 10015, 10005, 12, 1438),
        (10007, 10007, 9991, 9991, 130, -90, -40, 3, 10002, 10016, 9989, 10000, 10010, 9995, 10000, 10010, 9995, 12, 1531),
        (9991, 9991, 9991, 9991, 0, 0, -40, 0, 10002, 10016, 9989, None, None, None, None, None, None, 12, 1531),
        (9991, 9991, 9991, 9991, 0, 0, -40, 0, 10002, 10016, 9989, None, None, None, None, None, None, 12, 1531),
        (10020, 10020, 10020, 10020, 60, 60, 20, 1, 10006, 10025, 9987, 10020, 10020, 10020, 10000, 10015, 9995, 13, 1403),
    ]
    assert [r.open_time for r in got] == [0, 60000, 120000, 180000, 240000]


def test_gap_mode_zero(trades):
    got = plan.close_bars(trades, 60_000, 5, 1440, gap_mode="zero").orderBy("bar_start").collect()
    assert [(r.atr, r.parkinson) for r in got][-1] == (2, 0)


def test_cells(trades):
    got = {(r.bar_start, r.level): (r.bid_qty, r.ask_qty, r.bid_trades, r.ask_trades) for r in c.footprint_cells(trades, 60_000, 5).collect()}
    assert got == {(0, 10015): (0, 50, 0, 1), (0, 10010): (10, 0, 1, 0), (0, 10005): (20, 0, 1, 0), (0, 10000): (0, 30, 0, 1), (60000, 10010): (40, 0, 1, 0), (60000, 10000): (70, 0, 1, 0), (60000, 9995): (0, 20, 0, 1), (240000, 10020): (0, 60, 0, 1)}


def test_flags(trades):
    _, flags = plan.flagged_cells(trades, 60_000, 5, 1440)
    got = {(r.bar_start, r.level): (set(r.b), set(r.a)) for r in flags.select("bar_start", "level", flag_names("bid_flags").alias("b"), flag_names("ask_flags").alias("a")).collect()}
    bid, ask = got[0, 10015]
    assert {"ZERO_PRINT", "HIGH", "POC_BAR", "VAH_BAR", "POC_FP"} <= bid and {"DELTA_DOMINATION", "IMBALANCE", "UNFINISHED_AUCTION"} == ask
    # the mark of the first bar's low is cleared by the second bar, which covers it
    assert not {"FINISHED_AUCTION", "UNFINISHED_AUCTION"} & got[0, 10000][0]
    assert "FINISHED_AUCTION" in got[60000, 9995][0]


def area(v, open_edges):
    c_, total = int(np.argmax(v)), int(v.sum())
    u, d, have = c_ - 1, c_ + 1, int(v[c_])
    at = lambda i: int(v[i]) if 0 <= i < len(v) else 0
    while have * 10 < total * 7:
        a, b = at(u), at(d)
        if a > b:
            have, u = have + a, u - 1
        elif b > a:
            have, d = have + b, d + 1
        else:
            have += a + b
            u = u - 1 if open_edges or u >= 0 else u
            d = d + 1 if open_edges or d < len(v) else d
    return c_, u + 1, d - 1


@pytest.mark.parametrize("open_edges", [False, True])
def test_value_area_matches_a_plain_model(spark, open_edges):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k in range(300):
        v = rng.integers(0, 6, rng.integers(1, 12))
        v[rng.integers(len(v))] += 1
        nz = np.flatnonzero(v)
        v = v[nz[0] : nz[-1] + 1]
        rows += [(k, int(1000 - 5 * i), int(x)) for i, x in enumerate(v) if x]
        want[k] = tuple(1000 - 5 * i for i in area(v, open_edges))
    got = c.value_area(spark.createDataFrame(rows, "k long, level long, volume long"), ["k"], 5, open_edges)
    assert {r.k: (r.poc, r.vah, r.val) for r in got.collect()} == want


@pytest.mark.parametrize("open_edges", [False, True])
def test_sparse_value_areas_are_the_dense_ones(spark, open_edges):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for k in range(400):
        places = np.unique(rng.integers(0, rng.choice([6, 40, 300]), rng.integers(1, 12)))
        places -= places[0]
        volumes = rng.integers(0, 5, len(places))
        dense = np.zeros(places[-1] + 1, np.int64)
        dense[places] = volumes
        want[k] = tuple(1000 - 5 * int(i) for i in area(dense, open_edges))
        assert tuple(1000 - 5 * i for i in ind.grow_area(places, volumes, open_edges)) == want[k]
        rows += [(k, int(1000 - 5 * i), int(x)) for i, x in zip(places, volumes, strict=True)]
    got = c.value_area(spark.createDataFrame(rows, "k long, level long, volume long"), ["k"], 5, open_edges)
    assert {r.k: (r.poc, r.vah, r.val) for r in got.collect()} == want


def test_one_outlier_tick_costs_no_levels(spark):
    far = 10**13
    ticks = [("X", 1, 0, 10_000, 5, False), ("X", 2, 1, 10_001, 9, True), ("X", 3, 2, far, 1, False), ("X", 4, 60_000, 10_000, 2, True), ("X", 5, 120_000, far, 1, True)]
    bars = plan.close_bars(spark.createDataFrame(ticks, TRADE), 60_000, 1, 24).orderBy("bar_start").collect()
    assert [(r.poc, r.vah, r.val) for r in bars] == [(10_001, 10_001, 10_000), (10_000, 10_000, 10_000), (far, far, far)]
    assert [r.session_poc for r in bars] == [10_001, 10_001, 10_001]


def test_known_value_areas():
    assert area(np.array([10, 0, 0, 50, 20, 20, 5]), False) == (3, 3, 5)
    assert area(np.array([5, 30, 30, 5]), False) == (1, 1, 2)


def test_properties_of_derived_bars(spark):
    t = v.event_trades(spark, SF)
    bars, cells = c.bars_ohlcv(t, v.HOUR), c.footprint_cells(t, v.HOUR, v.SCALE)
    sums = cells.groupBy("symbol", "bar_start").agg(F.sum(F.col("bid_qty") + F.col("ask_qty")).alias("s"), F.sum(F.col("ask_qty") - F.col("bid_qty")).alias("d"), F.max("level").alias("top"), F.min("level").alias("bottom"))
    area_ = c.value_area(c.bar_volume_profile(cells), ["symbol", "bar_start"], v.SCALE)
    joined = bars.join(sums, ["symbol", "bar_start"]).join(area_, ["symbol", "bar_start"])
    assert joined.count() == bars.count()
    assert joined.where("s <> volume OR d <> delta OR NOT (bottom <= val AND val <= poc AND poc <= vah AND vah <= top)").count() == 0
    shuffled = c.bars_ohlcv(t.orderBy(F.rand(3)), v.HOUR)
    assert shuffled.exceptAll(bars).count() == 0


def test_anchored_and_chained_sessions(spark):
    bars = spark.createDataFrame([("A", 0), ("A", 10), ("A", 25), ("A", 40), ("A", 70)], "symbol string, bar_start long")
    chained = {r.bar_start: (r.session_no, r.session_start, r.bar_idx) for r in ind.assign_sessions(bars, 10, 2).collect()}
    assert chained == {0: (0, 0, 0), 10: (0, 0, 1), 25: (1, 25, 0), 40: (1, 25, 1), 70: (2, 70, 0)} or chained[40] == (1, 25, 1)
    anchored = {r.bar_start: r.session_no for r in ind.assign_sessions(bars, 10, 2, "anchored").collect()}
    assert anchored == {0: 0, 10: 0, 25: 1, 40: 2, 70: 3}


def test_empty_input(spark):
    none = spark.createDataFrame([], TRADE)
    assert plan.close_bars(none, 60_000, 5, 24).count() == 0
    assert plan.flagged_cells(none, 60_000, 5, 24)[1].count() == 0


def test_blocks_of_bars_carry_the_rows_before(spark):
    bars = spark.createDataFrame([("X", s, s * 100 + i) for s in range(9) for i in range(1 + s % 4 * 3)] + [("Y", 0, 5)], "symbol string, session_no long, bar_start long")
    got = ind.row_blocks(bars, 3, 8).collect()
    own = sorted((r.symbol, r._rank, r.session_no, r.bar_start) for r in got if r._own)
    want = {s: sorted((r.session_no, r.bar_start) for r in bars.collect() if r.symbol == s) for s in "XY"}
    assert own == [(s, i, *row) for s in "XY" for i, row in enumerate(want[s])]
    held = {(r.symbol, r._block, r._rank) for r in got}
    assert all((s, i // 8, j) in held for s, i, *_ in own for j in range(max(0, i - 3), i))
    assert len(got) - len(own) <= 3 * (len(own) // 8 + 1)

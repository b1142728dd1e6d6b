"""Scalar expressions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import scalars as s


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "q"), [(7, 2, 3), (-7, 2, -4), (7, -2, -4), (-7, -2, 3), (-8, 2, -4), (5, 0, None), (None, 3, None)])
def test_floor_div_floors(spark, a, b, q):
    assert one(spark, s.floor_div(F.lit(a).cast("long"), F.lit(b))) == q


@pytest.mark.parametrize(("step", "decimals"), [("0.01", 2), ("0.001", 3), ("1e-8", 8), ("0.00000001", 8), ("1e-4", 4), ("1", 0), ("100", 0), ("1e+2", 0), ("0.1", 1), ("10", 0), ("1e-5", 5)])
def test_precision(spark, step, decimals):
    assert one(spark, s.precision_of(F.lit(step))) == decimals
    assert one(spark, s.multiplier_of(F.lit(step))) == 10**decimals


@pytest.mark.parametrize(("percent", "bps"), [(100.0, 10000), (1.5, 150), (0.0, 0), (0.05, 5), (0.01, 1), (1e-4, 0)])
def test_bps(spark, percent, bps):
    assert one(spark, s.to_bps(F.lit(percent))) == bps


@pytest.mark.parametrize(("n", "row"), [(500000, 5000), (501000, 4000), (497000, 8000), (504999, 1), (506000, None), (494999, None)])
def test_grid_row(spark, n, row):
    assert one(spark, s.grid_row(F.lit(n), F.lit(500000), 1, 5000, 10001)) == row


def test_grid_rows_of_wider_levels(spark):
    rows = [one(spark, s.grid_row(F.lit(n), F.lit(10000), 10, 500, 1000)) for n in (10000, 10100, 15010, 5000)]
    assert rows == [500, 490, None, None]
    assert one(spark, s.row_price(F.lit(4000), F.lit(500000), 1, 5000)) == 501000


@pytest.mark.parametrize(("bars", "sell", "col"), [(0, True, 0), (0, False, 1), (1, True, 2), (1, False, 3), (23, True, 46), (23, False, 47), (24, False, None)])
def test_grid_col(spark, bars, sell, col):
    t = 3_600_000
    assert one(spark, s.grid_col(F.lit(t + bars * t), F.lit(sell), F.lit(t), t, 48)) == col


def test_grid_col_before_the_base(spark):
    assert one(spark, s.grid_col(F.lit(3_599_999), F.lit(False), F.lit(3_600_000), 3_600_000, 48)) is None


def test_levels_do_not_need_a_base(spark):
    for n, scale, level in ((9996, 5, 10000), (10000, 5, 10000), (-3, 5, 0), (10001, 5, 10005)):
        assert one(spark, s.price_level(F.lit(n), scale)) == level


def test_conversions(spark):
    assert one(spark, s.to_n_qty(F.lit(1.23456), 1000)) == 1235
    assert one(spark, s.to_n_qty(F.lit(0.001), 1000)) == 1
    assert one(spark, s.to_price(F.lit(500055), 100)) == 5000.55
    assert one(spark, s.utc_date_str(F.lit(1_700_000_000_000))) == "2023-11-14"
    assert one(spark, s.utc_date_str(F.lit(-1))) == "1969-12-31"
    shape = one(spark, s.chart_shape(F.lit(3_600_000), F.lit(1), F.lit(5)))
    assert (shape.bar_count, shape.cols, shape.panel_cols, shape.total_bars) == (24, 48, 50, 120)


@pytest.mark.parametrize("family", list(s.FAMILIES))
def test_flags_are_dense_and_do_not_overlap(family):
    assert sorted(s.FAMILIES[family].values()) == [1 << i for i in range(len(s.FAMILIES[family]))]


def test_flag_names_and_order_sides(spark):
    assert one(spark, s.flag_names(F.lit(1 | 4 | 16 | 512).cast("long"), "order")) == ["LONG", "BUY", "LIMIT", "FILLED"]
    assert one(spark, s.flag_names(F.lit(0).cast("long"))) == []
    opens = [one(spark, s.is_open_order(F.lit(m).cast("long"))) for m in (5, 10, 9, 6)]
    assert opens == [True, True, False, False]


def test_child_ids_convert_both_ways(spark):
    assert one(spark, s.tp_id(F.lit(7))) == 1_000_000_007
    assert one(spark, s.sl_id(s.tp_id(F.lit(7)))) == 2_000_000_007
    assert one(spark, s.tp_id(s.sl_id(F.lit(7)))) == 1_000_000_007
    assert one(spark, s.tp_id(F.lit(1_000_000_007))) == 1_000_000_007


def test_money(spark):
    assert one(spark, s.tp_sl_price(F.lit(10003), F.lit(250), F.lit(True), True)) == 10253
    assert one(spark, s.tp_sl_price(F.lit(10003), F.lit(250), F.lit(True), False)) == 9753
    assert one(spark, s.tp_sl_price(F.lit(10003), F.lit(250), F.lit(False), True)) == 9753
    assert one(spark, s.position_size(F.lit(10**10), 100, 20, 5 * 10**8)) == 20 * 10**8
    assert one(spark, s.position_size(F.lit(10**8), 100, 20, 5 * 10**8)) is None
    assert one(spark, s.slipped_price(F.lit(10000), F.lit(True))) == 10005
    assert one(spark, s.slipped_price(F.lit(10000), F.lit(False))) == 9995
    assert one(spark, s.pnl(F.lit(10000), F.lit(10100), F.lit(500), F.lit(False))) == -50_000_000
    assert one(spark, s.commission(F.lit(10000), F.lit(1000), F.lit(True))) == 2_000_000
    assert one(spark, s.margin(F.lit(10000), F.lit(1000), 20)) == 500_000_000
    assert one(spark, s.loss_ok(F.lit(900), F.lit(1000))) is False and one(spark, s.lock_ok(F.lit(99), F.lit(1000))) is True
    assert one(spark, s.signal_fresh(F.lit(1000), F.lit(2000))) is False and one(spark, s.rel_pct(F.lit(5), F.lit(0))) is None

"""Column expressions on scaled integers: rounding, grid arithmetic, flags, order arithmetic.

Prices and quantities are integers scaled by a multiplier. Divisions floor, and rounding is half to even.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of cell flags and of order flags, and the offsets of child order ids.
CELL_FLAGS = {
    "BID_DELTA_DOMINATION_FP": 1, "ASK_DELTA_DOMINATION_FP": 2, "VWAP_FP": 4, "UPPER_BAND_FP": 8, "LOWER_BAND_FP": 16, "POC_FP": 32,
    "VAL_FP": 64, "VAH_FP": 128, "OPEN": 256, "CLOSE": 512, "HIGH": 1024, "LOW": 2048, "POC_BAR": 4096, "VAL_BAR": 8192, "VAH_BAR": 16384,
    "UNFINISHED_AUCTION": 32768, "FINISHED_AUCTION": 65536, "DELTA_DOMINATION": 131072, "ZERO_PRINT": 262144, "IMBALANCE": 524288,
    "BIG_CLUSTER": 1048576,
}
ORDER_FLAGS = {"LONG": 1, "SHORT": 2, "BUY": 4, "SELL": 8, "LIMIT": 16, "MARKET": 32, "MARKET_TRIGGER": 64, "NEW": 128, "CANCEL": 256, "FILLED": 512, "CANCELED": 1024}
FAMILIES = {"cell": CELL_FLAGS, "order": ORDER_FLAGS}
TP_OFFSET, SL_OFFSET = 1_000_000_000, 2_000_000_000
MONEY = 10**8


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _long(x: Column | str | int) -> Column:
    return _c(x).cast("long")


def floor_div(a: Column | str | int, b: Column | str | int) -> Column:
    """Integer quotient rounded down, for either sign; null on a zero divisor."""
    a, b = _c(a).cast("long"), F.nullif(_c(b).cast("long"), F.lit(0).cast("long"))
    left = a % b
    left = F.when((left != 0) & ((left < 0) != (b < 0)), left + b).otherwise(left)
    return _whole(a - left, b)


def _whole(a: Column, b: Column) -> Column:
    """Exact quotient of two longs where ``b`` divides ``a``."""
    return F.call_function("div", a, b)


def precision_of(step: Column | str) -> Column:
    """Decimals of a tick or lot size given as text, also in scientific notation; 0 from 1 upwards."""
    fraction = F.split_part(_c(step).cast("double").cast("decimal(38,18)").cast("string"), F.lit("."), F.lit(2))
    return F.when(_c(step).cast("double") >= 1, 0).otherwise(F.length(F.regexp_replace(fraction, "0+$", ""))).cast("int")


def multiplier_of(step: Column | str) -> Column:
    return F.pow(F.lit(10), precision_of(step)).cast("long")


def to_bps(percent: Column | str) -> Column:
    return F.bround(_c(percent) / 100 * 10_000).cast("long")


def price_level(n_price: Column | str, scale: int | Column) -> Column:
    """The level that covers a price: the next multiple of ``scale`` upwards."""
    scale = _c(scale)
    return (-floor_div(-_c(n_price), scale) * scale).cast("long")


def grid_row(n_price: Column | str, base: Column | str, scale: int | Column, center: int | Column, rows: int | Column) -> Column:
    row = floor_div(_c(base) - _c(n_price), scale) + _c(center)
    return F.when((row > 0) & (row < _c(rows)), row)


def row_price(row: Column | str, base: Column | str, scale: int, center: int) -> Column:
    return (_c(center) - _c(row)) * scale + _c(base)


def grid_col(ts_ms: Column | str, is_sell: Column | str, base_ms: Column | str, tf: int | Column, cols: int | Column) -> Column:
    col = floor_div(_c(ts_ms) - _c(base_ms), tf) * 2 + F.when(_c(is_sell), 0).otherwise(1)
    return F.when((col >= 0) & (col < _c(cols)), col)


def bar_start(ts_ms: Column | str, tf: int | Column) -> Column:
    return _c(ts_ms) - F.pmod(_c(ts_ms), _c(tf))


def to_price(n_price: Column | str, mult: int) -> Column:
    return _c(n_price) / mult


def to_n_qty(qty: Column | str, mult: int) -> Column:
    return F.bround(_c(qty) * mult).cast("long")


def utc_date_str(ts_ms: Column | str) -> Column:
    """``YYYY-MM-DD`` in UTC, whatever the session's time zone."""
    return F.date_format(F.date_from_unix_date(floor_div(ts_ms, 86_400_000).cast("int")), "yyyy-MM-dd")


def chart_shape(tf_ms: Column | str, days: Column | str, total_days: Column | str) -> Column:
    """Struct of bar_count, cols, panel_cols and total_bars for a chart of ``days`` days."""
    bars = _whole(_c(days).cast("long") * 86_400_000, _c(tf_ms).cast("long"))
    total = _whole(_c(total_days).cast("long") * 86_400_000, _c(tf_ms).cast("long"))
    return F.struct(bars.alias("bar_count"), (bars * 2).alias("cols"), (bars * 2 + 2).alias("panel_cols"), total.alias("total_bars"))


def signed_qty(n_qty: Column | str, is_sell: Column | str) -> Column:
    return F.when(_c(is_sell), -_c(n_qty)).otherwise(_c(n_qty))


def has_flag(mask: Column | str, flag: str, family: str = "cell") -> Column:
    return any_flag(mask, [flag], family)


def any_flag(mask: Column | str, flags: Iterable[str], family: str = "cell") -> Column:
    return _c(mask).bitwiseAND(F.lit(sum(FAMILIES[family][f] for f in flags)).cast("long")) != 0


def flag_names(mask: Column | str, family: str = "cell") -> Column:
    return F.array_compact(F.array(*[F.when(has_flag(mask, n, family), n) for n in FAMILIES[family]]))


def is_open_order(mask: Column | str) -> Column:
    """Buying long or selling short opens; the other two close."""
    return (has_flag(mask, "BUY", "order") & has_flag(mask, "LONG", "order")) | (has_flag(mask, "SELL", "order") & has_flag(mask, "SHORT", "order"))


def tp_sl_price(entry: Column | str, dev_bps: Column | str, is_long: Column | str, is_tp: bool) -> Column:
    ticks = floor_div(_long(entry) * _c(dev_bps), 10_000)
    return F.when(_c(is_long) == F.lit(is_tp), _c(entry) + ticks).otherwise(_c(entry) - ticks)


def is_tp_id(order_id: Column | str) -> Column:
    return (_c(order_id) >= TP_OFFSET) & (_c(order_id) < SL_OFFSET)


def is_sl_id(order_id: Column | str) -> Column:
    return _c(order_id) >= SL_OFFSET


def tp_id(order_id: Column | str) -> Column:
    i = _c(order_id)
    return F.when(is_tp_id(i), i).when(is_sl_id(i), i - SL_OFFSET + TP_OFFSET).otherwise(i + TP_OFFSET)


def sl_id(order_id: Column | str) -> Column:
    i = _c(order_id)
    return F.when(is_sl_id(i), i).when(is_tp_id(i), i - TP_OFFSET + SL_OFFSET).otherwise(i + SL_OFFSET)


def position_size(available: Column | str, entry_bps: Column | str | int, leverage: Column | str | int, min_size: Column | str | int) -> Column:
    """Money put into a position, null unless above ``min_size`` (all in scaled money)."""
    size = floor_div(_long(available) * _c(entry_bps), 10_000) * _c(leverage)
    return F.when(size > _c(min_size), size)


def size_to_qty(nominal: Column | str, n_price: Column | str, price_mult: int, qty_mult: int, money: int = MONEY) -> Column:
    return F.bround(_c(nominal) / money * price_mult * qty_mult / F.nullif(_c(n_price), F.lit(0))).cast("long")


def loss_ok(balance: Column | str, start: Column | str, max_loss_bps: int | Column = 1000) -> Column:
    return _c(balance) > _c(start) - floor_div(_long(start) * max_loss_bps, 10_000)


def lock_ok(locked: Column | str, balance: Column | str, max_lock_bps: int | Column = 1000) -> Column:
    return _c(locked) < floor_div(_long(balance) * max_lock_bps, 10_000)


def signal_fresh(ts_ms: Column | str, now_ms: Column | str, expiry_ms: int = 1000) -> Column:
    return _c(ts_ms) + expiry_ms > _c(now_ms)


def _notional(n_price: Column | str, n_qty: Column | str, price_mult: int, qty_mult: int) -> Column:
    return _c(n_price) / price_mult * (_c(n_qty) / qty_mult)


def margin(n_price: Column | str, n_qty: Column | str, leverage: Column | str | int = 20, price_mult: int = 100, qty_mult: int = 1000) -> Column:
    return F.bround(_notional(n_price, n_qty, price_mult, qty_mult) / _c(leverage) * MONEY).cast("long")


def pnl(entry: Column | str, exit_price: Column | str, n_qty: Column | str, is_long: Column | str, price_mult: int = 100, qty_mult: int = 1000) -> Column:
    moved = F.when(_c(is_long), _c(exit_price) - _c(entry)).otherwise(_c(entry) - _c(exit_price))
    return F.bround(moved / price_mult * (_c(n_qty) / qty_mult) * MONEY).cast("long")


def commission(n_price: Column | str, n_qty: Column | str, is_maker: Column | str, maker_bps: int = 2, taker_bps: int = 5, price_mult: int = 100, qty_mult: int = 1000) -> Column:
    rate = F.when(_c(is_maker), maker_bps).otherwise(taker_bps)
    return F.bround(_notional(n_price, n_qty, price_mult, qty_mult) * MONEY * rate / 10_000).cast("long")


def slipped_price(n_price: Column | str, is_buy: Column | str, slip_bps: int | Column = 5) -> Column:
    ticks = floor_div(_long(n_price) * slip_bps, 10_000)
    return F.when(_c(is_buy), _c(n_price) + ticks).otherwise(_c(n_price) - ticks)


def rel_pct(value: Column | str, base: Column | str) -> Column:
    return (_c(value) - _c(base)) / F.nullif(_c(base), F.lit(0)) * 100


def bar_measures() -> dict[str, Column]:
    """Measures of bar columns n_trades, volume, delta, open, high, low, close, atr and parkinson; null on a zero divisor."""
    c = {n: F.col(n) for n in ("n_trades", "volume", "delta", "open", "high", "low", "close", "atr", "parkinson")}
    return {
        "avg_trade_size": floor_div(c["volume"], c["n_trades"]),
        "delta_ratio": c["delta"] / F.nullif(c["volume"], F.lit(0)),
        "range": c["high"] - c["low"],
        "range_percent": c["high"] / F.nullif(c["low"], F.lit(0)) - 1,
        "change": c["close"] - c["open"],
        "change_percent": c["close"] / F.nullif(c["open"], F.lit(0)) - 1,
        "atr_percent": (c["atr"] + c["close"]) / F.nullif(c["close"], F.lit(0)) - 1,
        "parkinson_percent": F.sqrt(c["parkinson"] / 1e9 / (4 * F.ln(F.lit(2.0)))),
    }

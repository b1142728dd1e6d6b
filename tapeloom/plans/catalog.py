"""The registered queries of the order-flow operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import cells as c
from ..operators import flags as fl
from ..operators import indicators as ind
from ..operators import ledger as led
from ..operators import lifecycle as life
from ..operators import outcomes as out
from ..operators import resample as res
from ..operators import signals as sig
from ..sources import decoders as dec
from ..sources import stores
from ..sources.scratch import shared_folder, stored
from ..streaming import accounts as acc
from ..streaming import trades as st
from . import bars as plan
from . import views as v

HOUR, DAY, SCALE, N = v.HOUR, v.DAY, v.SCALE, v.BAR_COUNT
BAR = ["symbol", "bar_start"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n ".join(parts) + "\n"


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# --- 2.2 scalars ------------------------------------------------------------------------------------------------


@query(with_(v.TRADES) + """SELECT trade_id, 2 AS price_decimals, CAST(100 AS BIGINT) AS price_mult, CAST(round_even(n_price / 100.0 * 100, 0) AS BIGINT) AS bps,
 CAST(ceil(n_price / 100.0) AS BIGINT) * 100 AS level,
 CASE WHEN CAST(floor((20000 - n_price) / 100.0) AS BIGINT) + 300 > 0 AND CAST(floor((20000 - n_price) / 100.0) AS BIGINT) + 300 < 400 THEN CAST(floor((20000 - n_price) / 100.0) AS BIGINT) + 300 END AS grid_row,
 CASE WHEN (ts_ms - 1704067200000) // 3600000 * 2 + CASE WHEN is_sell THEN 0 ELSE 1 END < 48 THEN (ts_ms - 1704067200000) // 3600000 * 2 + CASE WHEN is_sell THEN 0 ELSE 1 END END AS grid_col,
 ts_ms - ts_ms % 3600000 AS bar_start, n_price / 100 AS price, CAST(round_even(n_qty / 1000 * 1000, 0) AS BIGINT) AS qty_back, strftime(epoch_ms(ts_ms), '%Y-%m-%d') AS day, CASE WHEN is_sell THEN -n_qty ELSE n_qty END AS signed_qty FROM trades""")
def b1_b10_grid_and_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.event_trades(spark, sf_dir).withColumn("tick", F.lit("1e-2"))
    return t.select(
        "trade_id", s.precision_of("tick").alias("price_decimals"), s.multiplier_of("tick").alias("price_mult"), s.to_bps(F.col("n_price") / 100).alias("bps"), s.price_level("n_price", SCALE).alias("level"),
        s.grid_row("n_price", F.lit(20_000), SCALE, 300, 400).alias("grid_row"), s.grid_col("ts_ms", "is_sell", F.lit(1_704_067_200_000), HOUR, 48).alias("grid_col"), s.bar_start("ts_ms", HOUR).alias("bar_start"),
        s.to_price("n_price", 100).alias("price"), s.to_n_qty(F.col("n_qty") / 1000, 1000).alias("qty_back"), s.utc_date_str("ts_ms").alias("day"), s.signed_qty("n_qty", "is_sell").alias("signed_qty"),
    )


@query(with_(v.TRADES) + """SELECT symbol, CAST(d * 24 AS BIGINT) AS bar_count, CAST(d * 48 AS BIGINT) AS cols, CAST(d * 48 + 2 AS BIGINT) AS panel_cols, CAST(d * 5 * 24 AS BIGINT) AS total_bars
 FROM (SELECT symbol, max(n_qty) % 7 + 1 AS d FROM trades GROUP BY symbol)""")
def b9_chart_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.event_trades(spark, sf_dir).groupBy("symbol").agg((F.max("n_qty") % 7 + 1).alias("d"))
    return p.select("symbol", s.chart_shape(F.lit(HOUR), "d", F.col("d") * 5).alias("x")).select("symbol", "x.*")


@query(with_(v.TRADES) + """, o AS (SELECT *, (CASE WHEN trade_id % 2 = 0 THEN 1 ELSE 2 END) + (CASE WHEN is_sell THEN 8 ELSE 4 END) + (CASE WHEN trade_id % 3 = 0 THEN 16 ELSE 32 END) + 512 AS mask, trade_id % 2 = 0 AS is_long FROM trades)
 SELECT trade_id, CAST(mask AS BIGINT) AS mask, (is_long AND NOT is_sell) OR (NOT is_long AND is_sell) AS opens, array_to_string(list_filter([CASE WHEN is_long THEN 'LONG' END, CASE WHEN NOT is_long THEN 'SHORT' END, CASE WHEN NOT is_sell THEN 'BUY' END, CASE WHEN is_sell THEN 'SELL' END,
 CASE WHEN trade_id % 3 = 0 THEN 'LIMIT' END, CASE WHEN trade_id % 3 <> 0 THEN 'MARKET' END, 'FILLED'], lambda x: x IS NOT NULL), ' ') AS names,
 CASE WHEN is_long THEN n_price + n_price * 250 // 10000 ELSE n_price - n_price * 250 // 10000 END AS tp, CASE WHEN is_long THEN n_price - n_price * 250 // 10000 ELSE n_price + n_price * 250 // 10000 END AS sl,
 trade_id + 1000000000 AS tp_id, trade_id + 2000000000 AS sl_id, true AS is_tp, true AS is_sl, trade_id + 2000000000 AS tp_as_sl,
 CASE WHEN n_price * 1000000 * 100 // 10000 * 20 > 500000000 THEN n_price * 1000000 * 100 // 10000 * 20 END AS size,
 10000000000 - n_price * 100000 > 10000000000 - 1000000000 AS loss_ok, n_price * 50000 < 1000000000 AS lock_ok, ts_ms + 1000 > 1705000000000 AS fresh,
 CAST(round_even(n_price / 100 * (n_qty / 1000) / 20 * 100000000, 0) AS BIGINT) AS margin,
 CAST(round_even(CASE WHEN is_long THEN 25000 - n_price ELSE n_price - 25000 END / 100 * (n_qty / 1000) * 100000000, 0) AS BIGINT) AS pnl,
 CAST(round_even(n_price / 100 * (n_qty / 1000) * 100000000 * (CASE WHEN trade_id % 3 = 0 THEN 2 ELSE 5 END) / 10000, 0) AS BIGINT) AS fee,
 CASE WHEN is_sell THEN n_price - n_price * 5 // 10000 ELSE n_price + n_price * 5 // 10000 END AS slipped, round((n_price - 20000) / 20000 * 100, 6) AS rel_pct FROM o""")
def b12_b23_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.event_trades(spark, sf_dir)
    long, maker, buy = F.col("trade_id") % 2 == 0, F.col("trade_id") % 3 == 0, ~F.col("is_sell")
    mask = F.when(long, 1).otherwise(2) + F.when(buy, 4).otherwise(8) + F.when(maker, 16).otherwise(32) + 512
    money = F.col("n_price") * 1_000_000
    o = t.withColumns({"mask": mask.cast("long"), "is_long": long})
    return o.select(
        "trade_id", "mask", s.is_open_order("mask").alias("opens"), F.array_join(s.flag_names("mask", "order"), " ").alias("names"),
        s.tp_sl_price("n_price", F.lit(250), "is_long", True).alias("tp"), s.tp_sl_price("n_price", F.lit(250), "is_long", False).alias("sl"), s.tp_id("trade_id").alias("tp_id"), s.sl_id("trade_id").alias("sl_id"),
        s.is_tp_id(s.tp_id("trade_id")).alias("is_tp"), s.is_sl_id(s.sl_id("trade_id")).alias("is_sl"), s.sl_id(s.tp_id("trade_id")).alias("tp_as_sl"),
        s.position_size(money, 100, 20, 5 * 10**8).alias("size"), s.loss_ok(F.lit(10**10) - F.col("n_price") * 100_000, F.lit(10**10)).alias("loss_ok"), s.lock_ok(F.col("n_price") * 50_000, F.lit(10**10)).alias("lock_ok"),
        s.signal_fresh("ts_ms", F.lit(1_705_000_000_000)).alias("fresh"), s.margin("n_price", "n_qty", 20).alias("margin"), s.pnl("n_price", F.lit(25_000), "n_qty", "is_long").alias("pnl"), s.commission("n_price", "n_qty", maker).alias("fee"),
        s.slipped_price("n_price", buy).alias("slipped"), F.round(s.rel_pct("n_price", F.lit(20_000)), 6).alias("rel_pct"),
    )


# --- 2.3 cells, bars, profiles ----------------------------------------------------------------------------------


@query(with_(v.TRADES, v.CELLS) + "SELECT * FROM cells")
def c1_c2_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.footprint_cells(v.event_trades(spark, sf_dir), HOUR, SCALE)


@query(with_(v.TRADES, v.BARS) + "SELECT symbol, bar_start, open, high, low, close, volume, delta, n_trades, open_time, last_trade_time FROM bars")
def c3_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.hourly_bars(spark, sf_dir).drop("pq", "ppq")


_ITEMS = """t AS (SELECT CAST(l_suppkey % 10 AS VARCHAR) AS symbol, epoch_us(l_shipdate) // 1000 AS ts_ms, CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS n_price, CAST(l_quantity AS BIGINT) AS n_qty, l_returnflag = 'R' AS is_sell,
 (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS k FROM lineitem)"""


@query(with_(_ITEMS) + """SELECT symbol, ts_ms - ts_ms % 86400000 AS bar_start, arg_min(n_price, (ts_ms, k)) AS open, max(n_price) AS high, min(n_price) AS low, arg_max(n_price, (ts_ms, k)) AS close, CAST(sum(n_qty) AS BIGINT) AS volume,
 CAST(sum(CASE WHEN is_sell THEN -n_qty ELSE n_qty END) AS BIGINT) AS delta, count(*) AS n_trades FROM t GROUP BY ALL""")
def c3_daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.bars_ohlcv(v.item_trades(spark, sf_dir), DAY).select(*BAR, "open", "high", "low", "close", "volume", "delta", "n_trades")


@query(with_(_ITEMS) + """SELECT symbol, ts_ms - ts_ms % 86400000 AS bar_start, CAST(ceil(n_price / 1000.0) AS BIGINT) * 1000 AS level, CAST(sum(CASE WHEN is_sell THEN n_qty ELSE 0 END) AS BIGINT) AS bid_qty, CAST(sum(CASE WHEN is_sell THEN 0 ELSE n_qty END) AS BIGINT) AS ask_qty,
 count(*) FILTER (is_sell) AS bid_trades, count(*) FILTER (NOT is_sell) AS ask_trades FROM t GROUP BY ALL""")
def c1_daily_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.footprint_cells(v.item_trades(spark, sf_dir), DAY, 1000)


@query(with_(v.TRADES, v.CELLS) + "SELECT symbol, bar_start, level, bid_qty + ask_qty AS volume, ask_qty - bid_qty AS delta FROM cells")
def c4_c5_bar_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = c.footprint_cells(v.event_trades(spark, sf_dir), HOUR, SCALE)
    return c.bar_volume_profile(cells).join(c.bar_delta_profile(cells), [*BAR, "level"])


#: Chained sessions of 24 hourly bars, one recursion step for each session.
_SESSIONS = """starts AS (SELECT symbol, 0 AS session_no, min(bar_start) AS session_start FROM bars GROUP BY symbol
 UNION ALL SELECT s.symbol, s.session_no + 1, (SELECT min(b.bar_start) FROM bars b WHERE b.symbol = s.symbol AND b.bar_start >= s.session_start + 86400000) FROM starts s
 WHERE EXISTS (SELECT 1 FROM bars b WHERE b.symbol = s.symbol AND b.bar_start >= s.session_start + 86400000)),
 sbars AS (SELECT b.*, CAST(s.session_no AS BIGINT) AS session_no, s.session_start, (b.bar_start - s.session_start) // 3600000 AS bar_idx FROM bars b JOIN starts s ON b.symbol = s.symbol AND b.bar_start >= s.session_start AND b.bar_start < s.session_start + 86400000)"""
_CHAIN = with_(v.TRADES, v.BARS, _SESSIONS, recursive=True)


@query(_CHAIN + "SELECT symbol, bar_start, session_no, session_start, bar_idx FROM sbars")
def d1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.session_bars(v.event_trades(spark, sf_dir), HOUR, N).select(*BAR, "session_no", "session_start", "bar_idx")


@query(with_(v.TRADES, v.BARS) + "SELECT symbol, bar_start, (bar_start - f) // 86400000 AS session_no, f + (bar_start - f) // 86400000 * 86400000 AS session_start, (bar_start - f) % 86400000 // 3600000 AS bar_idx FROM (SELECT *, min(bar_start) OVER (PARTITION BY symbol) AS f FROM bars)")
def d1_anchored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.session_bars(v.event_trades(spark, sf_dir), HOUR, N, "anchored").select(*BAR, "session_no", "session_start", "bar_idx")


_SCELLS = "scells AS (SELECT cells.*, session_no FROM cells JOIN sbars USING (symbol, bar_start))"
_CHAIN_CELLS = with_(v.TRADES, v.BARS, _SESSIONS, v.CELLS, _SCELLS, recursive=True)


def _session_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = v.event_trades(spark, sf_dir)
    bars = plan.session_bars(t, HOUR, N)
    return plan.session_cells(t, bars, HOUR, SCALE), bars


@query(_CHAIN_CELLS + "SELECT symbol, session_no, level, CAST(sum(bid_qty + ask_qty) AS BIGINT) AS volume, CAST(sum(ask_qty - bid_qty) AS BIGINT) AS delta, CAST(sum(bid_trades + ask_trades) AS BIGINT) AS trades, CAST((sum(bid_qty + ask_qty) - sum(ask_qty - bid_qty)) // 2 AS BIGINT) AS bid, CAST(sum(ask_qty) AS BIGINT) AS ask FROM scells GROUP BY ALL")
def c6_c8_session_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.session_qty_at(c.session_profiles(_session_cells(spark, sf_dir)[0]))


@query(_CHAIN_CELLS + "SELECT b.symbol, b.session_no, b.bar_start, x.level, CAST(sum(x.bid_qty + x.ask_qty) AS BIGINT) AS volume, CAST(sum(x.ask_qty - x.bid_qty) AS BIGINT) AS delta FROM sbars b JOIN scells x ON x.symbol = b.symbol AND x.session_no = b.session_no AND x.bar_start <= b.bar_start GROUP BY ALL")
def c9_running_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.running_profile(*_session_cells(spark, sf_dir))


@query(with_(v.TRADES, v.CELLS) + "SELECT symbol, bar_start, arg_max(level, (bid_qty + ask_qty, level)) AS poc FROM cells GROUP BY ALL")
def c10_poc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.poc(c.bar_volume_profile(c.footprint_cells(v.event_trades(spark, sf_dir), HOUR, SCALE)), BAR)


#: Value areas with hard edges, one recursion step for each growth.
_AREA = """ends AS (SELECT symbol, bar_start, max(level) AS hi, min(level) AS lo, CAST(sum(bid_qty + ask_qty) AS BIGINT) AS tot, arg_max(level, (bid_qty + ask_qty, level)) AS poc FROM cells GROUP BY ALL),
 grown AS (SELECT e.symbol, e.bar_start, hi, lo, tot, poc, poc + 100 AS u, poc - 100 AS d, CAST(bid_qty + ask_qty AS BIGINT) AS cur FROM ends e JOIN cells c ON c.symbol = e.symbol AND c.bar_start = e.bar_start AND c.level = e.poc
 UNION ALL SELECT g.symbol, g.bar_start, hi, lo, tot, poc, CASE WHEN a > b OR (a = b AND u <= hi) THEN u + 100 ELSE u END, CASE WHEN b > a OR (a = b AND d >= lo) THEN d - 100 ELSE d END, cur + CASE WHEN a >= b THEN a ELSE 0 END + CASE WHEN b >= a THEN b ELSE 0 END
 FROM (SELECT g.*, coalesce(x.bid_qty + x.ask_qty, 0) AS a, coalesce(y.bid_qty + y.ask_qty, 0) AS b FROM grown g LEFT JOIN cells x ON x.symbol = g.symbol AND x.bar_start = g.bar_start AND x.level = g.u LEFT JOIN cells y ON y.symbol = g.symbol AND y.bar_start = g.bar_start AND y.level = g.d
 WHERE g.cur * 10 < g.tot * 7) g)"""


@query(with_(v.TRADES, v.CELLS, _AREA, recursive=True) + "SELECT symbol, bar_start, poc, max(u) - 100 AS vah, min(d) + 100 AS val FROM grown GROUP BY symbol, bar_start, poc")
def c11_value_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.value_area(c.bar_volume_profile(c.footprint_cells(v.event_trades(spark, sf_dir), HOUR, SCALE)), BAR, SCALE)


#: The same walk over the traded levels alone; a stretch of untraded levels is one step.
_SPARSE_AREA = """wide AS (SELECT symbol, bar_start, level, bid_qty + ask_qty AS volume FROM cells UNION ALL SELECT DISTINCT symbol, bar_start, 10000000000000, 1 FROM cells),
 listed AS (SELECT symbol, bar_start, list(level ORDER BY level DESC) AS lv, list(CAST(volume AS BIGINT) ORDER BY level DESC) AS vo, CAST(sum(volume) AS BIGINT) AS tot FROM wide GROUP BY ALL),
 walked AS (SELECT *, lv[c] AS poc, lv[c] + 100 AS u, lv[c] - 100 AS d, c - 1 AS iu, c + 1 AS id, vo[c] AS cur FROM (SELECT *, CAST(list_position(vo, list_max(vo)) AS BIGINT) AS c FROM listed)
 UNION ALL SELECT symbol, bar_start, lv, vo, tot, c, poc, CASE WHEN a > b OR (a = b AND a > 0) THEN u + 100 WHEN b > a THEN u ELSE least(u + gap, lv[1] + 100) END, CASE WHEN b > a OR (a = b AND a > 0) THEN d - 100 WHEN a > b THEN d ELSE greatest(d - gap, lv[len(lv)] - 100) END,
  CASE WHEN a >= b AND a > 0 THEN iu - 1 ELSE iu END, CASE WHEN b >= a AND b > 0 THEN id + 1 ELSE id END, cur + CASE WHEN a >= b THEN a ELSE 0 END + CASE WHEN b >= a THEN b ELSE 0 END
 FROM (SELECT *, CASE WHEN iu >= 1 AND lv[iu] = u THEN vo[iu] ELSE 0 END AS a, CASE WHEN id <= len(lv) AND lv[id] = d THEN vo[id] ELSE 0 END AS b, least(CASE WHEN iu >= 1 THEN lv[iu] - u END, CASE WHEN id <= len(lv) THEN d - lv[id] END) AS gap FROM walked WHERE cur * 10 < tot * 7))"""


@query(with_(v.TRADES, v.CELLS, _SPARSE_AREA, recursive=True) + "SELECT symbol, bar_start, poc, u - 100 AS vah, d + 100 AS val FROM walked WHERE cur * 10 >= tot * 7")
def c11_sparse_value_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar with one more unit traded a hundred billion levels away."""
    profile = c.bar_volume_profile(c.footprint_cells(v.event_trades(spark, sf_dir), HOUR, SCALE))
    outliers = profile.select(*BAR).distinct().select(*BAR, F.lit(10_000_000_000_000).alias("level"), F.lit(1).cast("long").alias("volume"))
    return c.value_area(profile.union(outliers), BAR, SCALE)


@query(with_(v.TRADES, v.CELLS) + "SELECT symbol, bar_start, arg_max(level, (bid_qty + ask_qty, level)) AS level, arg_max(bid_qty, (bid_qty + ask_qty, level)) AS bid, arg_max(ask_qty, (bid_qty + ask_qty, level)) AS ask, arg_max(bid_qty + ask_qty, (bid_qty + ask_qty, level)) AS sum, arg_max(ask_qty - bid_qty, (bid_qty + ask_qty, level)) AS delta FROM cells GROUP BY ALL")
def c12_qty_at_poc(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = c.footprint_cells(v.event_trades(spark, sf_dir), HOUR, SCALE)
    return c.qty_at(cells, c.poc(c.bar_volume_profile(cells), BAR), "poc")


@query(with_(v.TRADES, v.CELLS) + "SELECT * FROM cells")
def c13_bar_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.event_trades(spark, sf_dir)
    return c.bar_slice(c.footprint_cells(t, HOUR, SCALE), c.bars_ohlcv(t, HOUR), SCALE)


@query(with_(v.TRADES) + "SELECT tf, symbol, ts_ms - ts_ms % tf AS bar_start, arg_min(n_price, (ts_ms, trade_id)) AS open, max(n_price) AS high, min(n_price) AS low, arg_max(n_price, (ts_ms, trade_id)) AS close, CAST(sum(n_qty) AS BIGINT) AS volume, count(*) AS n_trades FROM trades, (SELECT unnest([CAST(1800000 AS BIGINT), 3600000, 14400000]) AS tf) GROUP BY ALL")
def c15_multi_timeframe_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.multi_timeframe_bars(v.event_trades(spark, sf_dir), [1_800_000, HOUR, 14_400_000]).select("tf", *BAR, "open", "high", "low", "close", "volume", "n_trades")


# --- 2.4 indicators ---------------------------------------------------------------------------------------------

_FILLED = """spans AS (SELECT symbol, session_no, session_start, CASE WHEN session_no < max(session_no) OVER (PARTITION BY symbol) THEN session_start + 23 * 3600000 ELSE l END AS last FROM (SELECT symbol, session_no, session_start, max(bar_start) AS l FROM sbars GROUP BY symbol, session_no, session_start)),
 frame AS (SELECT symbol, session_no, session_start, unnest(range(session_start, last + 1, 3600000)) AS bar_start FROM spans),
 joined AS (SELECT f.symbol, f.session_no, f.session_start, f.bar_start, b.open, b.high, b.low, b.close, coalesce(b.volume, 0) AS volume, coalesce(b.delta, 0) AS delta, coalesce(b.n_trades, 0) AS n_trades, coalesce(b.open_time, f.bar_start) AS open_time, coalesce(b.last_trade_time, f.bar_start) AS last_trade_time, coalesce(b.pq, 0) AS pq, coalesce(b.ppq, 0) AS ppq, b.n_trades IS NULL AS is_filled,
 last_value(b.close IGNORE NULLS) OVER (PARTITION BY f.symbol, f.session_no ORDER BY f.bar_start) AS carried FROM frame f LEFT JOIN sbars b ON b.symbol = f.symbol AND b.session_no = f.session_no AND b.bar_start = f.bar_start),
 filled AS (SELECT symbol, session_no, session_start, bar_start, (bar_start - session_start) // 3600000 AS bar_idx, coalesce(open, carried) AS open, coalesce(high, carried) AS high, coalesce(low, carried) AS low, coalesce(close, carried) AS close, volume, delta, n_trades, open_time, last_trade_time, pq, ppq, is_filled FROM joined)"""
_FILL = with_(v.TRADES, v.BARS, _SESSIONS, _FILLED, recursive=True)


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.fill_missing_bars(plan.session_bars(v.event_trades(spark, sf_dir), HOUR, N), HOUR, N)


@query(_FILL + """SELECT symbol, session_no, bar_start, bar_idx, open, high, low, close, volume, open_time, is_filled, CAST(sum(delta) OVER s AS BIGINT) AS cvd, CAST(round_even(CAST(sum(pq) OVER s AS DOUBLE) / CAST(sum(volume) OVER s AS DOUBLE), 0) AS BIGINT) AS vwap,
 greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS true_range, CAST(round_even(coalesce(ln(high / nullif(low, 0)) * ln(high / nullif(low, 0)) * 1000000000, 0), 0) AS BIGINT) AS park_term FROM filled WINDOW s AS (PARTITION BY symbol, session_no ORDER BY bar_start)""")
def d2_d5_filled_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ind.parkinson_term(ind.true_range(ind.vwap_bands(ind.cvd(_filled(spark, sf_dir)))))
    return b.select("symbol", "session_no", "bar_start", "bar_idx", "open", "high", "low", "close", "volume", "open_time", "is_filled", "cvd", "vwap", "true_range", "park_term")


_RANGED = """ranged AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr, CAST(round_even(coalesce(ln(high / nullif(low, 0)) * ln(high / nullif(low, 0)) * 1000000000, 0), 0) AS BIGINT) AS pt FROM filled WINDOW s AS (PARTITION BY symbol, session_no ORDER BY bar_start)),
 folded AS (SELECT symbol, session_no, bar_start, bar_idx, tr AS atr, pt AS parkinson FROM ranged WHERE bar_idx = 0
 UNION ALL SELECT r.symbol, r.session_no, r.bar_start, r.bar_idx, CASE WHEN r.is_filled THEN f.atr ELSE (f.atr * 13 + r.tr) // 14 END, CASE WHEN r.is_filled THEN f.parkinson ELSE (f.parkinson * 11 + r.pt) // 12 END
 FROM folded f JOIN ranged r ON r.symbol = f.symbol AND r.session_no = f.session_no AND r.bar_idx = f.bar_idx + 1)"""


@query(with_(v.TRADES, v.BARS, _SESSIONS, _FILLED, _RANGED, recursive=True) + "SELECT symbol, session_no, bar_start, atr, parkinson FROM folded")
def d6_d7_atr_parkinson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.parkinson(ind.atr(_filled(spark, sf_dir))).select("symbol", "session_no", "bar_start", "atr", "parkinson")


@query(_FILL + """SELECT symbol, session_no, bar_start, CASE WHEN count(*) OVER w >= 21 THEN CAST(sum(volume) OVER w // 21 AS BIGINT) END AS ma_volume, CASE WHEN count(*) OVER w >= 21 THEN CAST(sum(n_trades) OVER w // 21 AS BIGINT) END AS ma_trades,
 CASE WHEN count(*) OVER w >= 21 AND count(*) FILTER (n_trades > 0) OVER w > 0 THEN CAST(sum(CASE WHEN n_trades > 0 THEN volume // n_trades END) OVER w // count(*) FILTER (n_trades > 0) OVER w AS BIGINT) END AS ma_trade_size
 FROM filled WINDOW w AS (PARTITION BY symbol ORDER BY session_no, bar_start ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)""")
def d8_d10_moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.moving_averages(_filled(spark, sf_dir)).select("symbol", "session_no", "bar_start", "ma_volume", "ma_trades", "ma_trade_size")


#: The session's profile as of each bar, and its value area on a grid without ends.
_SESSION_AREA = """run AS (SELECT b.symbol, b.session_no, b.bar_start, x.level, CAST(sum(x.bid_qty + x.ask_qty) AS BIGINT) AS v FROM sbars b JOIN scells x ON x.symbol = b.symbol AND x.session_no = b.session_no AND x.bar_start <= b.bar_start GROUP BY ALL),
 sends AS (SELECT symbol, session_no, bar_start, CAST(sum(v) AS BIGINT) AS tot, arg_max(level, (v, level)) AS poc, max(v) AS top FROM run GROUP BY ALL),
 sgrown AS (SELECT symbol, session_no, bar_start, tot, poc, poc + 100 AS u, poc - 100 AS d, top AS cur FROM sends
 UNION ALL SELECT symbol, session_no, bar_start, tot, poc, CASE WHEN a >= b THEN u + 100 ELSE u END, CASE WHEN b >= a THEN d - 100 ELSE d END, cur + CASE WHEN a >= b THEN a ELSE 0 END + CASE WHEN b >= a THEN b ELSE 0 END
 FROM (SELECT g.*, coalesce(x.v, 0) AS a, coalesce(y.v, 0) AS b FROM sgrown g LEFT JOIN run x ON x.symbol = g.symbol AND x.session_no = g.session_no AND x.bar_start = g.bar_start AND x.level = g.u LEFT JOIN run y ON y.symbol = g.symbol AND y.session_no = g.session_no AND y.bar_start = g.bar_start AND y.level = g.d WHERE g.cur * 10 < g.tot * 7)),
 sarea AS (SELECT symbol, bar_start, poc AS session_poc, max(u) - 100 AS session_vah, min(d) + 100 AS session_val FROM sgrown GROUP BY symbol, bar_start, poc),
 area AS (SELECT symbol, bar_start, poc, max(u) - 100 AS vah, min(d) + 100 AS val FROM grown GROUP BY symbol, bar_start, poc)"""
_ALL_BARS = """summed AS (SELECT f.*, CAST(sum(delta) OVER s AS BIGINT) AS cvd, CAST(sum(pq) OVER s AS DOUBLE) / CAST(sum(volume) OVER s AS DOUBLE) AS mean, CAST(sum(ppq) OVER s AS DOUBLE) / CAST(sum(volume) OVER s AS DOUBLE) AS sq, CASE WHEN count(*) OVER w >= 21 THEN CAST(sum(volume) OVER w // 21 AS BIGINT) END AS ma_volume,
 CASE WHEN count(*) OVER w >= 21 THEN CAST(sum(n_trades) OVER w // 21 AS BIGINT) END AS ma_trades, CASE WHEN count(*) OVER w >= 21 AND count(*) FILTER (n_trades > 0) OVER w > 0 THEN CAST(sum(CASE WHEN n_trades > 0 THEN volume // n_trades END) OVER w // count(*) FILTER (n_trades > 0) OVER w AS BIGINT) END AS ma_trade_size
 FROM filled f WINDOW s AS (PARTITION BY symbol, session_no ORDER BY bar_start), w AS (PARTITION BY symbol ORDER BY session_no, bar_start ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)),
 allbars AS (SELECT m.symbol, m.session_no, m.session_start, m.bar_start, m.bar_idx, m.open, m.high, m.low, m.close, m.volume, m.delta, m.n_trades, m.open_time, m.last_trade_time, m.is_filled, cvd, CAST(round_even(mean, 0) AS BIGINT) AS vwap, CAST(round_even(mean + 2 * sqrt(greatest(0, sq - mean * mean)), 0) AS BIGINT) AS vwap_up,
 CAST(round_even(mean - 2 * sqrt(greatest(0, sq - mean * mean)), 0) AS BIGINT) AS vwap_low, r.tr AS true_range, r.pt AS park_term, x.atr, x.parkinson, ma_volume, ma_trades, ma_trade_size, poc, vah, val, session_poc, session_vah, session_val
 FROM summed m JOIN ranged r USING (symbol, session_no, bar_start) JOIN folded x USING (symbol, session_no, bar_start) LEFT JOIN area USING (symbol, bar_start) LEFT JOIN sarea USING (symbol, bar_start))"""
_EVERYTHING = with_(v.TRADES, v.BARS, _SESSIONS, _FILLED, _RANGED, v.CELLS, _SCELLS, _AREA, _SESSION_AREA, _ALL_BARS, recursive=True)


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.close_bars(v.event_trades(spark, sf_dir), HOUR, SCALE, N)


def _flagged(spark: SparkSession, sf_dir: str, mult: float = 0.33) -> tuple[DataFrame, DataFrame]:
    return plan.flagged_cells(v.event_trades(spark, sf_dir), HOUR, SCALE, N, mult)


@query(_EVERYTHING + """SELECT *, CASE WHEN n_trades > 0 THEN volume // n_trades END AS avg_trade_size, round(delta / nullif(volume, 0), 9) AS delta_ratio, high - low AS "range", round(high / nullif(low, 0) - 1, 9) AS range_percent, close - open AS change, round(close / nullif(open, 0) - 1, 9) AS change_percent,
 round((atr + close) / nullif(close, 0) - 1, 9) AS atr_percent, round(sqrt(parkinson / 1e9 / (4 * ln(2.0))), 9) AS parkinson_percent FROM allbars""")
def d11_close_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _full(spark, sf_dir)
    return b.withColumns({k: F.round(x, 9) if k not in ("avg_trade_size", "range", "change") else x for k, x in s.bar_measures().items()})


@query(_EVERYTHING + "SELECT symbol, session_no, arg_max(session_poc, bar_start) AS session_poc, arg_max(session_vah, bar_start) AS session_vah, arg_max(session_val, bar_start) AS session_val, arg_max(vwap, bar_start) AS vwap, arg_max(vwap_up, bar_start) AS vwap_up, arg_max(vwap_low, bar_start) AS vwap_low, arg_max(close, bar_start) AS close FROM allbars WHERE n_trades > 0 GROUP BY symbol, session_no")
def c14_session_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.session_last(_full(spark, sf_dir).where("n_trades > 0"), ["session_poc", "session_vah", "session_val", "vwap", "vwap_up", "vwap_low", "close"])


# --- 2.5 flags --------------------------------------------------------------------------------------------------


@query(with_(v.TRADES, v.CELLS) + """, n AS (SELECT *, CASE WHEN lead(level) OVER w = level + 100 THEN lead(ask_qty) OVER w ELSE 0 END AS up, CASE WHEN lag(level) OVER w = level - 100 THEN lag(bid_qty) OVER w ELSE 0 END AS down, max(level) OVER (PARTITION BY symbol, bar_start) AS hi, min(level) OVER (PARTITION BY symbol, bar_start) AS lo FROM cells WINDOW w AS (PARTITION BY symbol, bar_start ORDER BY level)),
 m AS (SELECT symbol, bar_start, level, CAST((CASE WHEN bid_qty = 0 AND ask_qty > 0 THEN 262144 ELSE 0 END) + (CASE WHEN bid_qty > ask_qty THEN 131072 ELSE 0 END) + (CASE WHEN level < hi AND bid_qty > up * 3 THEN 524288 ELSE 0 END) AS BIGINT) AS bid_flags,
 CAST((CASE WHEN ask_qty = 0 AND bid_qty > 0 THEN 262144 ELSE 0 END) + (CASE WHEN ask_qty > bid_qty THEN 131072 ELSE 0 END) + (CASE WHEN level > lo AND ask_qty > down * 3 THEN 524288 ELSE 0 END) AS BIGINT) AS ask_flags FROM n)
 SELECT * FROM m WHERE bid_flags <> 0 OR ask_flags <> 0""")
def e3_e6_side_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = c.footprint_cells(v.event_trades(spark, sf_dir), HOUR, SCALE)
    rows = fl.flag_zero_print(cells).union(fl.flag_delta_domination(cells)).union(fl.flag_imbalance_diagonal(cells, SCALE))
    return rows.groupBy(*BAR, "level").agg(F.bit_or("bid_flags").alias("bid_flags"), F.bit_or("ask_flags").alias("ask_flags"))


@query(with_(v.TRADES, v.CELLS) + "SELECT symbol, bar_start, level, CAST(CASE WHEN bid_qty > ask_qty * 3 THEN 524288 ELSE 0 END AS BIGINT) AS bid_flags, CAST(CASE WHEN ask_qty > bid_qty * 3 THEN 524288 ELSE 0 END AS BIGINT) AS ask_flags FROM cells WHERE bid_qty > ask_qty * 3 OR ask_qty > bid_qty * 3")
def e5_horizontal_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flag_imbalance_horizontal(c.footprint_cells(v.event_trades(spark, sf_dir), HOUR, SCALE))


@query(_CHAIN_CELLS + """, e AS (SELECT symbol, bar_start, session_no, CAST(ceil(high / 100.0) AS BIGINT) * 100 AS hi, CAST(ceil(low / 100.0) AS BIGINT) * 100 AS lo FROM sbars),
 m AS (SELECT e.symbol, e.bar_start, e.session_no, c.level, 'ask' AS side, c.ask_qty = 0 AS done FROM e JOIN cells c ON c.symbol = e.symbol AND c.bar_start = e.bar_start AND c.level = e.hi UNION ALL SELECT e.symbol, e.bar_start, e.session_no, c.level, 'bid', c.bid_qty = 0 FROM e JOIN cells c ON c.symbol = e.symbol AND c.bar_start = e.bar_start AND c.level = e.lo)
 SELECT symbol, bar_start, level, CAST(CASE WHEN side = 'ask' THEN 0 WHEN done THEN 65536 ELSE 32768 END AS BIGINT) AS bid_flags, CAST(CASE WHEN side = 'bid' THEN 0 WHEN done THEN 65536 ELSE 32768 END AS BIGINT) AS ask_flags FROM m
 WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.symbol = m.symbol AND e.session_no = m.session_no AND e.bar_start > m.bar_start AND m.level BETWEEN e.lo AND e.hi)""")
def e9_auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, bars = _session_cells(spark, sf_dir)
    return fl.flag_auction(cells, bars, SCALE)


def _flags_sql(mult: float) -> str:
    """All flags, for a big-cluster multiple."""
    marks = lambda names: " UNION ALL ".join(f"SELECT symbol, bar_start, {level} AS level, {bit} AS b, 0 AS a FROM traded" for level, bit in names)
    up = lambda c_: f"CAST(ceil({c_} / 100.0) AS BIGINT) * 100"
    named = marks([(up("open"), 256), (up("close"), 512), (up("high"), 1024), (up("low"), 2048), ("poc", 4096), ("val", 8192), ("vah", 16384), ("session_poc", 32), ("session_val", 64), ("session_vah", 128), (up("vwap"), 4), (up("vwap_up"), 8), (up("vwap_low"), 16)])
    return f"""traded AS (SELECT * FROM allbars WHERE n_trades > 0), ready AS (SELECT symbol, bar_start, ma FROM (SELECT *, lag(ma_volume) OVER (PARTITION BY symbol ORDER BY session_no, bar_start) AS ma FROM allbars) WHERE ma > 0),
 side AS (SELECT *, CASE WHEN lead(level) OVER w = level + 100 THEN lead(ask_qty) OVER w ELSE 0 END AS up, CASE WHEN lag(level) OVER w = level - 100 THEN lag(bid_qty) OVER w ELSE 0 END AS down, max(level) OVER (PARTITION BY symbol, bar_start) AS hi, min(level) OVER (PARTITION BY symbol, bar_start) AS lo, sum(ask_qty - bid_qty) OVER (PARTITION BY symbol, session_no, level ORDER BY bar_start) AS so_far FROM scells WINDOW w AS (PARTITION BY symbol, bar_start ORDER BY level)),
 e AS (SELECT symbol, bar_start, session_no, {up("high")} AS hi, {up("low")} AS lo FROM traded),
 au AS (SELECT e.symbol, e.bar_start, e.session_no, c.level, 'ask' AS side, c.ask_qty = 0 AS done FROM e JOIN cells c ON c.symbol = e.symbol AND c.bar_start = e.bar_start AND c.level = e.hi UNION ALL SELECT e.symbol, e.bar_start, e.session_no, c.level, 'bid', c.bid_qty = 0 FROM e JOIN cells c ON c.symbol = e.symbol AND c.bar_start = e.bar_start AND c.level = e.lo),
 rows_ AS ({named} UNION ALL SELECT symbol, bar_start, level, (CASE WHEN bid_qty = 0 AND ask_qty > 0 THEN 262144 ELSE 0 END) + (CASE WHEN bid_qty > ask_qty THEN 131072 ELSE 0 END) + (CASE WHEN level < hi AND bid_qty > up * 3 THEN 524288 ELSE 0 END), (CASE WHEN ask_qty = 0 AND bid_qty > 0 THEN 262144 ELSE 0 END) + (CASE WHEN ask_qty > bid_qty THEN 131072 ELSE 0 END) + (CASE WHEN level > lo AND ask_qty > down * 3 THEN 524288 ELSE 0 END) FROM side
 UNION ALL SELECT symbol, bar_start, level, CASE WHEN bid_qty > ma * {round(mult * 10_000)} // 10000 THEN 1048576 ELSE 0 END, CASE WHEN ask_qty > ma * {round(mult * 10_000)} // 10000 THEN 1048576 ELSE 0 END FROM side JOIN ready USING (symbol, bar_start)
 UNION ALL SELECT symbol, bar_start, level, CASE WHEN so_far < 0 THEN 1 ELSE 0 END, CASE WHEN so_far < 0 THEN 0 ELSE 2 END FROM side JOIN ready USING (symbol, bar_start)
 UNION ALL SELECT symbol, bar_start, level, CASE WHEN side = 'ask' THEN 0 WHEN done THEN 65536 ELSE 32768 END, CASE WHEN side = 'bid' THEN 0 WHEN done THEN 65536 ELSE 32768 END FROM au WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.symbol = au.symbol AND e.session_no = au.session_no AND e.bar_start > au.bar_start AND au.level BETWEEN e.lo AND e.hi)),
 flags AS (SELECT symbol, bar_start, level, CAST(bit_or(b) AS BIGINT) AS bid_flags, CAST(bit_or(a) AS BIGINT) AS ask_flags FROM rows_ GROUP BY symbol, bar_start, level HAVING bit_or(b) <> 0 OR bit_or(a) <> 0)"""


@query(_EVERYTHING + ", " + _flags_sql(0.33) + " SELECT * FROM flags")
def e12_cell_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir)[1]


# --- 2.6 signals ------------------------------------------------------------------------------------------------

_SIGNALS = """sigs AS (SELECT symbol, last_trade_time AS ts_ms, close AS n_price, CASE WHEN close > open THEN 149 ELSE 154 END AS order_param, CASE WHEN n_trades % 2 = 0 THEN 500 ELSE 300 END AS tp_bps, 200 AS sl_bps FROM bars WHERE abs(delta) * 2 > volume)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.hourly_bars(spark, sf_dir)
    rule = F.abs("delta") * 2 > F.col("volume")
    return sig.number_signals(sig.signals(b, rule, "close", F.col("close") > F.col("open"), True, F.when(F.col("n_trades") % 2 == 0, 0).otherwise(300), 200))


@query(with_(v.TRADES, v.BARS, _SIGNALS) + "SELECT symbol, ts_ms, n_price, CAST(order_param AS BIGINT) AS order_param, CAST(tp_bps AS BIGINT) AS tp_bps, CAST(sl_bps AS BIGINT) AS sl_bps, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, n_price, order_param) AS signal_id FROM sigs")
def f1_f2_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir)


@query(_EVERYTHING + ", " + _flags_sql(0.1) + """, big AS (SELECT symbol, bar_start, bool_or(bid_flags & 1048576 <> 0) AS bb, bool_or(ask_flags & 1048576 <> 0) AS ba FROM flags JOIN (SELECT symbol, bar_start, poc FROM traded) USING (symbol, bar_start) WHERE level >= poc AND (bid_flags | ask_flags) & 1048576 <> 0 GROUP BY ALL),
 t AS (SELECT *, (atr + close) / close - 1 AS p, close > poc AND poc > vwap_low AND bb AS go_long, vwap_up > poc AND poc > close AND ba AS go_short FROM traded JOIN big USING (symbol, bar_start) WHERE bar_idx > 2),
 s AS (SELECT symbol, last_trade_time AS ts_ms, close AS n_price, CAST(CASE WHEN go_long THEN 149 ELSE 154 END AS BIGINT) AS order_param, CAST(round_even(p * 10000 * 2, 0) AS BIGINT) AS tp, CAST(round_even(p * 10000 * 4, 0) AS BIGINT) AS sl FROM t WHERE p >= 0.0025 AND (go_long OR go_short))
 SELECT symbol, ts_ms, n_price, order_param, CASE WHEN tp = 0 THEN 500 ELSE tp END AS tp_bps, CASE WHEN sl = 0 THEN 500 ELSE sl END AS sl_bps, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, n_price, order_param) AS signal_id FROM s""")
def f3_trapped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.number_signals(sig.trapped_orders_rule(*_flagged(spark, sf_dir, 0.1), least_bars=2))


@query(_CHAIN + "SELECT symbol, session_no, bar_start, high FROM (SELECT *, coalesce(max(high) OVER (PARTITION BY symbol, session_no ORDER BY bar_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM sbars) WHERE high > m")
def f4_on_bar_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    def new_highs(pdf):
        return pdf[pdf["high"] > pdf["high"].cummax().shift(1).fillna(0)][["symbol", "session_no", "bar_start", "high"]]

    return sig.on_bar_close(plan.session_bars(v.event_trades(spark, sf_dir), HOUR, N), new_highs, "symbol string, session_no long, bar_start long, high long")


# --- 2.7 outcomes -----------------------------------------------------------------------------------------------

_ORDERS = """orders_ AS (SELECT symbol || ':' || row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, n_price, order_param) AS order_id, symbol, ts_ms, n_price, order_param = 149 AS is_long, tp_bps, sl_bps FROM sigs),
 entries AS (SELECT o.*, f.fill_ts, f.fill_id, CASE WHEN is_long THEN f.px + f.px * 5 // 10000 ELSE f.px - f.px * 5 // 10000 END AS fill_price FROM orders_ o LEFT JOIN LATERAL (SELECT t.ts_ms AS fill_ts, t.trade_id AS fill_id, t.n_price AS px FROM trades t WHERE t.symbol = o.symbol AND t.ts_ms >= o.ts_ms + 100 ORDER BY t.ts_ms, t.trade_id LIMIT 1) f ON true)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = stored(_signals(spark, sf_dir), "signals")
    return o.select(F.concat_ws(":", "symbol", F.col("signal_id").cast("string")).alias("order_id"), "symbol", "ts_ms", "n_price", s.has_flag("order_param", "LONG", "order").alias("is_long"), "tp_bps", "sl_bps")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.event_trades(spark, sf_dir)
    return stored(out.entry_fill(_orders(spark, sf_dir).withColumn("is_buy", F.col("is_long")), t, HOUR).drop("is_buy"), "entries")


@query(with_(v.TRADES, v.BARS, _SIGNALS, _ORDERS) + "SELECT order_id, symbol, ts_ms, n_price, is_long, CAST(tp_bps AS BIGINT) AS tp_bps, CAST(sl_bps AS BIGINT) AS sl_bps, fill_ts, fill_id, fill_price FROM entries")
def g1_entry_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir)


_LIMITS = """limits AS (SELECT order_id, symbol, ts_ms + 100 AS active_ts, CASE WHEN is_long THEN n_price - n_price * 3000 // 10000 ELSE n_price + n_price * 3000 // 10000 END AS n_price, is_long AS is_buy FROM orders_)"""


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    away = s.floor_div(F.col("n_price") * 3000, 10_000)
    return o.select("order_id", "symbol", (F.col("ts_ms") + 100).alias("active_ts"), F.when(F.col("is_long"), F.col("n_price") - away).otherwise(F.col("n_price") + away).alias("n_price"), F.col("is_long").alias("is_buy"), F.lit(False).alias("is_stop"))


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.event_trades(spark, sf_dir)
    return out.first_touch(_limits(spark, sf_dir), t, stored(c.bars_ohlcv(t, HOUR), "bars"), HOUR)


_TOUCHED = """touched AS (SELECT l.*, f.touch_ts, f.touch_id, CASE WHEN f.touch_ts IS NOT NULL THEN l.n_price END AS touch_price FROM limits l LEFT JOIN LATERAL (SELECT t.ts_ms AS touch_ts, t.trade_id AS touch_id FROM trades t WHERE t.symbol = l.symbol AND t.ts_ms >= l.active_ts AND CASE WHEN l.is_buy THEN t.n_price <= l.n_price ELSE t.n_price >= l.n_price END ORDER BY t.ts_ms, t.trade_id LIMIT 1) f ON true)"""


@query(with_(v.TRADES, v.BARS, _SIGNALS, _ORDERS, _LIMITS, _TOUCHED) + "SELECT order_id, symbol, active_ts, n_price, is_buy, false AS is_stop, touch_ts, touch_id, touch_price FROM touched")
def g2_first_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _touched(spark, sf_dir)


_BRACKET = """legs AS (SELECT order_id, symbol, is_long, fill_ts + 100 AS active_ts, CASE WHEN is_long THEN fill_price + fill_price * tp_bps // 10000 ELSE fill_price - fill_price * tp_bps // 10000 END AS tp, CASE WHEN is_long THEN fill_price - fill_price * sl_bps // 10000 ELSE fill_price + fill_price * sl_bps // 10000 END AS sl FROM entries WHERE fill_ts IS NOT NULL),
 exits AS (SELECT l.order_id, f.exit_ts, f.exit_id, CASE WHEN f.hit_tp THEN 'tp' ELSE 'sl' END AS exit_leg, CASE WHEN f.hit_tp THEN l.tp WHEN l.is_long THEN f.px - f.px * 5 // 10000 ELSE f.px + f.px * 5 // 10000 END AS exit_price
 FROM legs l JOIN LATERAL (SELECT t.ts_ms AS exit_ts, t.trade_id AS exit_id, t.n_price AS px, CASE WHEN l.is_long THEN t.n_price >= l.tp ELSE t.n_price <= l.tp END AS hit_tp FROM trades t WHERE t.symbol = l.symbol AND t.ts_ms >= l.active_ts
 AND (CASE WHEN l.is_long THEN t.n_price >= l.tp OR t.n_price <= l.sl ELSE t.n_price <= l.tp OR t.n_price >= l.sl END) ORDER BY t.ts_ms, t.trade_id LIMIT 1) f ON true),
 brackets AS (SELECT e.*, x.exit_leg, x.exit_ts, x.exit_id, x.exit_price FROM entries e LEFT JOIN exits x USING (order_id))"""


def _brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.event_trades(spark, sf_dir)
    return stored(out.bracket_outcome(_entries(spark, sf_dir), t, stored(c.bars_ohlcv(t, HOUR), "bars"), HOUR), "brackets")


@query(with_(v.TRADES, v.BARS, _SIGNALS, _ORDERS, _BRACKET) + "SELECT order_id, symbol, ts_ms, n_price, is_long, CAST(tp_bps AS BIGINT) AS tp_bps, CAST(sl_bps AS BIGINT) AS sl_bps, fill_ts, fill_id, fill_price, exit_leg, exit_ts, exit_id, exit_price FROM brackets")
def g3_bracket_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brackets(spark, sf_dir)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _brackets(spark, sf_dir).where("fill_ts IS NOT NULL")
    return b.select(F.lit(0).cast("long").alias("run_id"), "order_id", "symbol", "is_long", "ts_ms", F.col("exit_ts").alias("end_ts"), "fill_ts", "fill_price", "exit_ts", "exit_price", (F.col("exit_leg") == "tp").alias("exit_is_maker"))


_TAKEN = """cand AS (SELECT *, row_number() OVER (PARTITION BY symbol, is_long ORDER BY ts_ms, order_id) AS rn FROM brackets WHERE fill_ts IS NOT NULL),
 taken AS (SELECT order_id, symbol, is_long, rn, exit_ts FROM cand WHERE rn = 1 UNION ALL SELECT n.order_id, n.symbol, n.is_long, n.rn, n.exit_ts FROM taken t JOIN LATERAL (SELECT c.* FROM cand c WHERE c.symbol = t.symbol AND c.is_long = t.is_long AND c.rn > t.rn AND t.exit_ts IS NOT NULL AND c.ts_ms > t.exit_ts ORDER BY c.rn LIMIT 1) n ON true)"""


@query(with_(v.TRADES, v.BARS, _SIGNALS, _ORDERS, _BRACKET, _TAKEN, recursive=True) + "SELECT order_id, symbol, is_long FROM taken")
def g4_one_position_per_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out.one_position_per_side(_candidates(spark, sf_dir)).select("order_id", "symbol", "is_long")


#: The walk of each run: signal after signal, with the balance and the open positions (end, result, margin) carried along.
_WALK = """names AS (SELECT symbol, dense_rank() OVER (ORDER BY symbol) AS run_id FROM (SELECT DISTINCT symbol FROM bars)),
 entered AS (SELECT n.run_id, b.*, row_number() OVER (PARTITION BY n.run_id ORDER BY b.fill_ts, b.order_id) AS i FROM brackets b JOIN taken USING (order_id) JOIN names n ON n.symbol = b.symbol),
 walk AS (SELECT run_id, CAST(0 AS BIGINT) AS i, CAST(10000000000 AS BIGINT) AS balance, CAST([] AS STRUCT(x BIGINT, g BIGINT, m BIGINT)[]) AS held, false AS over, false AS taken, CAST(0 AS BIGINT) AS n_qty, CAST(0 AS BIGINT) AS fee, CAST(NULL AS BIGINT) AS pnl FROM (SELECT DISTINCT run_id FROM entered)
 UNION ALL SELECT run_id, i, CASE WHEN takes THEN bal - f ELSE bal END, CASE WHEN takes THEN list_append(still, {'x': exit_ts, 'g': CASE WHEN exit_ts IS NULL THEN 0 ELSE gain - xf END, 'm': CAST(round_even(worth / 20 * 100000000, 0) AS BIGINT)}) ELSE still END,
  ends, takes, q, f, CASE WHEN exit_ts IS NOT NULL THEN gain END
 FROM (SELECT *, CAST(round_even(worth * 100000000 * 5 / 10000, 0) AS BIGINT) AS f, CAST(round_even(exit_price / 100 * q / 1000 * 100000000 * (CASE WHEN exit_leg = 'tp' THEN 2 ELSE 5 END) / 10000, 0) AS BIGINT) AS xf,
   CAST(round_even((exit_price - fill_price) * (CASE WHEN is_long THEN 1 ELSE -1 END) / 100 * q / 1000 * 100000000, 0) AS BIGINT) AS gain
  FROM (SELECT *, fill_price / 100 * q / 1000 AS worth FROM (SELECT *, over OR lost OR (NOT locked_out AND size <= 500000000) AS ends, NOT (over OR lost) AND NOT locked_out AND size > 500000000 AND fill_price <> 0 AS takes, CAST(round_even(size / 100000000 * 100 * 1000 / nullif(fill_price, 0), 0) AS BIGINT) AS q
   FROM (SELECT *, bal <= 9000000000 AS lost, locked >= bal * 1000 // 10000 AS locked_out, (bal - locked) * 100 // 10000 * 20 AS size
    FROM (SELECT e.*, w.over, w.balance + CAST(coalesce(list_sum(list_transform(list_filter(w.held, lambda h: h.x <= e.fill_ts), lambda h: h.g)), 0) AS BIGINT) AS bal, list_filter(w.held, lambda h: h.x IS NULL OR h.x > e.fill_ts) AS still,
      CAST(coalesce(list_sum(list_transform(list_filter(w.held, lambda h: h.x IS NULL OR h.x > e.fill_ts), lambda h: h.m)), 0) AS BIGINT) AS locked FROM walk w JOIN entered e ON e.run_id = w.run_id AND e.i = w.i + 1))))))"""


@query(with_(v.TRADES, v.BARS, _SIGNALS, _ORDERS, _BRACKET, _TAKEN, _WALK, recursive=True) + "SELECT e.run_id, CAST(e.order_id AS VARCHAR) AS order_id, e.symbol, e.is_long, e.fill_ts, e.fill_price, e.exit_ts, e.exit_price, w.n_qty, w.fee, w.pnl, w.balance FROM walk w JOIN entered e USING (run_id, i) WHERE w.taken")
def g5_size_and_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _candidates(spark, sf_dir).drop("run_id")
    names = found.select("symbol").union(v.hourly_bars(spark, sf_dir).select("symbol")).distinct().withColumn("run_id", F.dense_rank().over(Window.orderBy("symbol")).cast("long"))
    runs = found.join(F.broadcast(names), "symbol")
    return out.size_and_gate(out.one_position_per_side(runs).drop("end_ts", "ts_ms"))


@query(with_(v.TRADES, v.BARS, _SIGNALS, _ORDERS, _LIMITS, _TOUCHED) + "SELECT order_id, touch_ts FROM touched WHERE touch_ts IS NOT NULL AND touch_ts < active_ts + 7200000 + 100")
def g6_cancel_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = _touched(spark, sf_dir)
    return out.cancel_effective(touched, touched.select("order_id", (F.col("active_ts") + 7_200_000).alias("cancel_ts"))).select("order_id", "touch_ts")


@query(with_(v.TRADES, v.BARS, _SIGNALS, _ORDERS, _BRACKET) + """SELECT order_id, CAST(least(0, min(p)) AS BIGINT) AS n_mae, CAST(greatest(0, max(p)) AS BIGINT) AS n_mfe FROM (SELECT b.order_id, round_even((CASE WHEN is_long THEN t.n_price - fill_price ELSE fill_price - t.n_price END) / 100 * (1500 / 1000) * 100000000, 0) AS p FROM brackets b JOIN trades t ON t.symbol = b.symbol AND t.ts_ms BETWEEN b.fill_ts AND b.exit_ts) GROUP BY order_id""")
def g7_mae_mfe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.event_trades(spark, sf_dir)
    held = _brackets(spark, sf_dir).where("exit_ts IS NOT NULL").withColumn("n_qty", F.lit(1500).cast("long"))
    return out.mae_mfe(held, t, c.bars_ohlcv(t, HOUR), HOUR).select("order_id", "n_mae", "n_mfe")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    f = v.run_fills(spark, sf_dir)
    ledger = led.position_ledger(f, v.runs_of(f))
    until = F.lead("ts_ms").over(Window.partitionBy("run_id").orderBy("seq"))
    held = ledger.select("run_id", "symbol", F.col("ts_ms").alias("since"), until.alias("until"), F.col("n_balance").alias("balance"), F.when(F.col("is_open"), F.col("n_qty")).otherwise(0).cast("long").alias("n_qty"), F.col("n_price").alias("entry"), "is_long")
    return held.where("until IS NOT NULL")


@query(with_(v.TRADES, v.BARS, v.FILLS, v.LEDGER) + """, states AS (SELECT run_id, symbol, ts_ms AS since, lead(ts_ms) OVER (PARTITION BY run_id ORDER BY seq) AS until, n_balance AS balance, CASE WHEN is_open THEN n_qty ELSE 0 END AS n_qty, n_price AS entry, is_long FROM balanced),
 samples AS (SELECT s.run_id, t.ts_ms - t.ts_ms % 3600000 AS bar_start, t.ts_ms, t.trade_id, s.balance + CASE WHEN s.n_qty > 0 THEN CAST(round_even((CASE WHEN s.is_long THEN t.n_price - s.entry ELSE s.entry - t.n_price END) / 100 * (s.n_qty / 1000) * 100000000, 0) AS BIGINT) ELSE 0 END AS v FROM states s JOIN trades t ON t.symbol = s.symbol AND t.ts_ms >= s.since AND t.ts_ms < s.until),
 b AS (SELECT run_id, bar_start, arg_min(v, (ts_ms, trade_id)) AS open, max(v) AS high, min(v) AS low, arg_max(v, (ts_ms, trade_id)) AS close FROM samples GROUP BY ALL),
 frame AS (SELECT run_id, unnest(range(min(bar_start), max(bar_start) + 1, 3600000)) AS bar_start FROM b GROUP BY run_id),
 j AS (SELECT f.run_id, f.bar_start, b.open, b.high, b.low, b.close, last_value(b.close IGNORE NULLS) OVER (PARTITION BY f.run_id ORDER BY f.bar_start) AS k FROM frame f LEFT JOIN b USING (run_id, bar_start))
 SELECT run_id, bar_start, coalesce(open, k) AS open, coalesce(high, k) AS high, coalesce(low, k) AS low, coalesce(close, k) AS close FROM j""")
def g8_equity_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.event_trades(spark, sf_dir)
    return out.equity_ohlc(stored(_states(spark, sf_dir), "states"), t, stored(c.bars_ohlcv(t, HOUR), "bars"), HOUR)


@query(with_(v.TRADES, v.BARS, v.FILLS) + "SELECT run_id, seq, CAST(sum(CASE WHEN is_open THEN n_price * n_qty ELSE -prev END) OVER (PARTITION BY run_id ORDER BY seq) AS BIGINT) AS locked FROM (SELECT *, lag(n_price * n_qty) OVER (PARTITION BY run_id ORDER BY seq) AS prev FROM fills)")
def g9_locked_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    f = v.run_fills(spark, sf_dir)
    notional = F.col("n_price") * F.col("n_qty")
    amount = F.when(s.is_open_order("order_param"), notional).otherwise(-F.lag(notional).over(Window.partitionBy("run_id").orderBy("seq")))
    return out.locked_margin(f.select("run_id", "ts_ms", "seq", amount.alias("amount"))).select("run_id", "seq", "locked")


@query("""WITH p AS (SELECT c_custkey, range(c_custkey % 4 + 1) AS a, range(10, 10 + c_custkey % 3 + 1) AS b FROM customer), r AS (SELECT *, unnest(range(greatest(len(a), len(b)))) AS i FROM p)
 SELECT c_custkey, CAST(i AS INTEGER) AS run_no, a[least(i, len(a) - 1) + 1] AS a, b[least(i, len(b) - 1) + 1] AS b FROM r""")
def g10_expand_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.sequence(F.lit(0).cast("long"), F.col("c_custkey") % 4).alias("a"), F.sequence(F.lit(10).cast("long"), F.col("c_custkey") % 3 + 10).alias("b"))
    return out.expand_runs(p, ["a", "b"])


@query("SELECT o_orderkey, CAST(i AS INTEGER) AS date_no, strftime(CAST(o_orderdate AS DATE) + CAST(i * 7 AS INTEGER), '%Y-%m-%d') AS date FROM (SELECT o_orderkey, o_orderdate, unnest(range(4)) AS i FROM orders)")
def g11_date_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return out.date_grid(o, "d", 7, 4).drop("d")


# --- 2.8 ledger and statistics ----------------------------------------------------------------------------------

_RUNS = with_(v.TRADES, v.BARS, v.FILLS, v.LEDGER, v.EQUITY)


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = stored(v.run_fills(spark, sf_dir), "fills")
    runs = v.runs_of(f)
    return led.position_ledger(f, runs), v.run_equity(f), runs


@query(_RUNS + "SELECT run_id, seq, is_open, is_long, CAST(entry AS BIGINT) AS n_entry, CAST(n_pnl AS BIGINT) AS n_pnl, n_balance FROM balanced")
def h1_position_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir)[0].select("run_id", "seq", "is_open", "is_long", "n_entry", "n_pnl", "n_balance")


@query(_RUNS + "SELECT run_id, seq, ts_ms, n_balance / 1e8 AS balance, n_price / 100 AS price, is_long, is_long AS is_buy FROM balanced WHERE is_open")
def h2_opened_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return led.opened_trades(_ledger(spark, sf_dir)[0]).drop("symbol")


@query(_RUNS + "SELECT run_id, seq, ts_ms, CASE WHEN pnl > 0 THEN 'green' ELSE 'red' END AS color, is_long, balance, price, pnl, round(pnl_pct, 6) AS pnl_pct, round(mae_pct, 6) + 0.0 AS mae_pct, round(mfe_pct, 6) AS mfe_pct, 5.0::DOUBLE AS planned_tp_pct, -3.0::DOUBLE AS planned_sl_pct FROM closed")
def h3_closed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return led.closed_trades(_ledger(spark, sf_dir)[0]).drop("symbol", "mae", "mfe").withColumns({k: F.round(k, 6) for k in ("pnl_pct", "mae_pct", "mfe_pct")})


_W = """w AS (SELECT run_id, count(*) AS n_closed, count(*) FILTER (pnl > 0) AS n_win, count(*) FILTER (pnl <= 0) AS n_loss, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS sum_win, coalesce(sum(pnl) FILTER (pnl <= 0), 0) AS sum_loss, avg(pnl) AS m, stddev_samp(pnl) AS sd,
 coalesce(avg(mfe_pct) FILTER (mfe_pct > 0), 0) AS avg_mfe_pct, coalesce(avg(mae_pct) FILTER (mae_pct < 0), 0) AS avg_mae_pct, count(*) FILTER (is_long) AS long_count, count(*) FILTER (NOT is_long) AS short_count, count(*) FILTER (is_long AND pnl > 0) AS lw, count(*) FILTER (NOT is_long AND pnl > 0) AS sw,
 coalesce(sum(pnl) FILTER (is_long), 0) AS long_pnl, coalesce(sum(pnl) FILTER (NOT is_long), 0) AS short_pnl FROM closed GROUP BY run_id),
 x AS (SELECT *, n_win / n_closed AS wr, CASE WHEN n_win > 0 THEN sum_win / n_win ELSE 0 END AS avg_win, CASE WHEN n_loss > 0 THEN sum_loss / n_loss ELSE 0 END AS avg_loss FROM w),
 y AS (SELECT *, CASE WHEN avg_loss <> 0 THEN abs(avg_win / avg_loss) ELSE 0 END AS payoff FROM x)"""


@query(_RUNS + f", {_W}" + """ SELECT run_id, n_closed, n_win, n_loss, round(sum_win, 8) AS sum_win, round(sum_loss, 8) AS sum_loss, round(wr * 100, 8) AS win_rate, round(avg_win, 8) AS avg_win, round(avg_loss, 8) AS avg_loss, round(wr * avg_win - n_loss / n_closed * abs(avg_loss), 8) AS expectancy, round(payoff, 8) AS payoff_ratio,
 round(CASE WHEN payoff > 0 THEN (wr - (1 - wr) / payoff) * 100 ELSE 0 END, 8) AS kelly_pct, round(CASE WHEN n_closed >= 5 AND sd > 0 THEN sqrt(n_closed) * m / sd ELSE 0 END, 8) AS sqn, round(avg_mfe_pct, 8) AS avg_mfe_pct, round(avg_mae_pct, 8) AS avg_mae_pct,
 long_count, round(CASE WHEN long_count > 0 THEN lw / long_count * 100 ELSE 0 END, 8) AS long_wr, round(long_pnl, 8) AS long_pnl, short_count, round(CASE WHEN short_count > 0 THEN sw / short_count * 100 ELSE 0 END, 8) AS short_wr, round(short_pnl, 8) AS short_pnl FROM y""")
def h6_h8_h10_h16_h17_h19_win_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = led.win_loss(led.closed_trades(_ledger(spark, sf_dir)[0])).drop("sqn_grade")
    return w.select([F.round(c_, 8).alias(c_) if t == "double" else c_ for c_, t in w.dtypes])


@query(_RUNS + """, p AS (SELECT run_id, max(n_balance / 1e8) AS x, arg_max(n_balance, seq) / 1e8 AS end_balance, sum(n_commission) / 1e8 AS fees, CAST(sum(CAST(n_price AS HUGEINT) * n_qty) AS DOUBLE) / 100000 AS turnover FROM balanced GROUP BY run_id), g AS (SELECT run_id, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS w, coalesce(sum(pnl) FILTER (pnl <= 0), 0) AS l FROM closed GROUP BY run_id)
 SELECT p.run_id, round(end_balance - 1000, 8) AS net_profit, round(turnover, 8) AS turnover, round(fees, 8) AS fees, round(CASE WHEN abs(coalesce(l, 0) - fees) > 0 THEN coalesce(w, 0) / abs(coalesce(l, 0) - fees) WHEN coalesce(w, 0) > 0 THEN w ELSE 1 END, 8) AS profit_factor FROM p LEFT JOIN g USING (run_id)""")
def h4_h5_h9_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, _, runs = _ledger(spark, sf_dir)
    joined = led.net_profit(ledger, runs).join(led.turnover_and_fees(ledger), "run_id").join(led.win_loss(led.closed_trades(ledger)).select("run_id", "sum_win", "sum_loss"), "run_id", "left").fillna(0)
    factor = led.profit_factor(F.col("sum_win"), F.col("sum_loss"), F.col("fees"))
    return joined.withColumn("profit_factor", factor).select("run_id", *[F.round(x, 8).alias(x) for x in ("net_profit", "turnover", "fees", "profit_factor")])


@query(_RUNS + """, o AS (SELECT run_id, ts_ms, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i FROM fills WHERE is_open), c AS (SELECT run_id, ts_ms, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i FROM fills WHERE NOT is_open)
 SELECT run_id, round(avg((c.ts_ms - o.ts_ms) / 60000), 4) AS avg_hold_minutes FROM o JOIN c USING (run_id, i) GROUP BY run_id""")
def h11_hold_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _ledger(spark, sf_dir)[0]
    return led.avg_hold_minutes(led.opened_trades(ledger), led.closed_trades(ledger)).select("run_id", F.round("avg_hold_minutes", 4).alias("avg_hold_minutes"))


@query(_RUNS + """, r AS (SELECT run_id, close / lag(close) OVER (PARTITION BY run_id ORDER BY ts_ms) - 1 AS r FROM equity), a AS (SELECT run_id, avg(r) AS m, stddev_samp(r) AS s, stddev_pop(r) AS p, sqrt(avg(r * r) FILTER (r < 0)) AS d FROM r WHERE r IS NOT NULL GROUP BY run_id)
 SELECT run_id, round(CASE WHEN p > 0 THEN m / s * sqrt(365.0 * 24) ELSE 0 END, 4) AS sharpe, round(CASE WHEN p > 0 THEN CASE WHEN d IS NULL THEN m / s * sqrt(365.0 * 24) WHEN d > 0 THEN m / d * sqrt(365.0 * 24) ELSE 0 END ELSE 0 END, 4) AS sortino FROM a""")
def h12_sharpe_sortino(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, equity, runs = _ledger(spark, sf_dir)
    several = equity.groupBy("run_id").count().where("count > 1").select("run_id")
    return led.sharpe_sortino(equity, runs).join(several, "run_id", "left_semi").select("run_id", F.round("sharpe", 4).alias("sharpe"), F.round("sortino", 4).alias("sortino"))


@query(_RUNS + """, s AS (SELECT run_id, seq, balance, greatest(1000, max(balance) OVER (PARTITION BY run_id ORDER BY seq)) AS peak FROM closed), d AS (SELECT run_id, seq AS q, max(high) OVER (PARTITION BY run_id ORDER BY ts_ms) AS peak, low FROM (SELECT equity.*, ts_ms AS seq FROM equity)),
 a AS (SELECT run_id, arg_max(peak - balance, ((peak - balance) / peak * 100, -seq)) AS v, max((peak - balance) / peak * 100) AS p FROM s GROUP BY run_id), b AS (SELECT run_id, arg_max(peak - low, ((peak - low) / peak * 100, -q)) AS v, max((peak - low) / peak * 100) AS p FROM d GROUP BY run_id)
 SELECT a.run_id, round(a.v, 4) AS static_dd_val, round(a.p, 4) AS static_dd_pct, round(b.v, 4) AS dynamic_dd_val, round(b.p, 4) AS dynamic_dd_pct FROM a JOIN b USING (run_id)""")
def h13_h14_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, equity, runs = _ledger(spark, sf_dir)
    d = led.max_drawdown(led.static_drawdown_series(led.closed_trades(ledger), runs), "static_dd").join(led.max_drawdown(led.dynamic_drawdown_series(equity), "dynamic_dd"), "run_id")
    return d.select("run_id", *[F.round(x, 4).alias(x) for x in d.columns[1:]])


@query(_RUNS + """, g AS (SELECT run_id, sign(pnl) AS side, row_number() OVER (PARTITION BY run_id ORDER BY seq) - row_number() OVER (PARTITION BY run_id, sign(pnl) ORDER BY seq) AS island FROM closed), n AS (SELECT run_id, side, count(*) AS n FROM g GROUP BY run_id, side, island)
 SELECT run_id, coalesce(max(n) FILTER (side = 1), 0) AS max_win_streak, coalesce(max(n) FILTER (side = -1), 0) AS max_loss_streak FROM n GROUP BY run_id""")
def h15_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return led.streaks(led.closed_trades(_ledger(spark, sf_dir)[0]))


#: All statistics of a run (rounded after adding 1e-10, so that exact halves round alike in both engines), without the grade of its SQN; absent ones are 0.
_STATS = _W + """, tf AS (SELECT run_id, arg_max(n_balance, seq) / 1e8 AS end_balance, sum(n_commission) / 1e8 AS fees, CAST(sum(CAST(n_price AS HUGEINT) * n_qty) AS DOUBLE) / 100000 AS turnover, CAST(make_timestamp(min(bar_start) * 1000) AS DATE) AS day FROM balanced GROUP BY run_id),
 ho AS (SELECT run_id, avg((c.ts_ms - o.ts_ms) / 60000) AS hold FROM (SELECT run_id, ts_ms, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i FROM fills WHERE is_open) o JOIN (SELECT run_id, ts_ms, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i FROM fills WHERE NOT is_open) c USING (run_id, i) GROUP BY run_id),
 re AS (SELECT run_id, avg(r) AS m, stddev_samp(r) AS s, stddev_pop(r) AS p, sqrt(avg(r * r) FILTER (r < 0)) AS d FROM (SELECT run_id, close / lag(close) OVER (PARTITION BY run_id ORDER BY ts_ms) - 1 AS r FROM equity) WHERE r IS NOT NULL GROUP BY run_id),
 sr AS (SELECT run_id, CASE WHEN p > 0 THEN m / s * sqrt(365.0 * 24) ELSE 0 END AS sharpe, CASE WHEN p > 0 THEN CASE WHEN d IS NULL THEN m / s * sqrt(365.0 * 24) WHEN d > 0 THEN m / d * sqrt(365.0 * 24) ELSE 0 END ELSE 0 END AS sortino FROM re),
 sp AS (SELECT run_id, seq, balance, greatest(1000, max(balance) OVER (PARTITION BY run_id ORDER BY seq)) AS peak FROM closed), dp AS (SELECT run_id, ts_ms AS seq, max(high) OVER (PARTITION BY run_id ORDER BY ts_ms) AS peak, low FROM equity),
 sd AS (SELECT run_id, arg_max(peak - balance, ((peak - balance) / peak * 100, -seq)) AS sv, max((peak - balance) / peak * 100) AS spct FROM sp GROUP BY run_id), dd AS (SELECT run_id, arg_max(peak - low, ((peak - low) / peak * 100, -seq)) AS dv, max((peak - low) / peak * 100) AS dpct FROM dp GROUP BY run_id),
 isl AS (SELECT run_id, side, count(*) AS n FROM (SELECT run_id, sign(pnl) AS side, row_number() OVER (PARTITION BY run_id ORDER BY seq) - row_number() OVER (PARTITION BY run_id, sign(pnl) ORDER BY seq) AS i FROM closed) GROUP BY run_id, side, i), st AS (SELECT run_id, coalesce(max(n) FILTER (side = 1), 0) AS ws, coalesce(max(n) FILTER (side = -1), 0) AS ls FROM isl GROUP BY run_id),
 js AS (SELECT run_id, end_balance, end_balance - 1000 AS net_profit, day, turnover, fees, coalesce(hold, 0) AS hold, coalesce(sharpe, 0) AS sharpe, coalesce(sortino, 0) AS sortino, coalesce(sv, 0) AS sv, coalesce(spct, 0) AS spct, coalesce(dv, 0) AS dv, coalesce(dpct, 0) AS dpct, coalesce(ws, 0) AS ws, coalesce(ls, 0) AS ls,
 coalesce(n_closed, 0) AS n_closed, coalesce(n_win, 0) AS n_win, coalesce(n_loss, 0) AS n_loss, coalesce(sum_win, 0) AS sum_win, coalesce(sum_loss, 0) AS sum_loss, coalesce(wr, 0) * 100 AS win_rate, coalesce(avg_win, 0) AS avg_win, coalesce(avg_loss, 0) AS avg_loss, coalesce(wr * avg_win - n_loss / n_closed * abs(avg_loss), 0) AS expectancy, coalesce(payoff, 0) AS payoff_ratio,
 CASE WHEN payoff > 0 THEN (wr - (1 - wr) / payoff) * 100 ELSE 0 END AS kelly_pct, CASE WHEN n_closed >= 5 AND sd > 0 THEN sqrt(n_closed) * m / sd ELSE 0 END AS sqn, coalesce(avg_mfe_pct, 0) AS avg_mfe_pct, coalesce(avg_mae_pct, 0) AS avg_mae_pct, coalesce(long_count, 0) AS long_count, CASE WHEN long_count > 0 THEN lw / long_count * 100 ELSE 0 END AS long_wr, coalesce(long_pnl, 0) AS long_pnl,
 coalesce(short_count, 0) AS short_count, CASE WHEN short_count > 0 THEN sw / short_count * 100 ELSE 0 END AS short_wr, coalesce(short_pnl, 0) AS short_pnl FROM tf LEFT JOIN y USING (run_id) LEFT JOIN ho USING (run_id) LEFT JOIN sr USING (run_id) LEFT JOIN sd USING (run_id) LEFT JOIN dd USING (run_id) LEFT JOIN st USING (run_id)),
 stats AS (SELECT *, CASE WHEN abs(sum_loss - fees) > 0 THEN sum_win / abs(sum_loss - fees) WHEN sum_win > 0 THEN sum_win ELSE 1 END AS profit_factor, CASE WHEN spct > 0 THEN net_profit / 1000 * 365.0 * 100 / spct ELSE 0 END AS calmar, CASE WHEN dv > 0 THEN net_profit / dv WHEN sv > 0 THEN net_profit / sv ELSE 0 END AS recovery_factor FROM js)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stored(v.run_fills(spark, sf_dir), "fills")
    return led.run_stats(f, v.run_equity(f), v.runs_of(f))


@query(_RUNS + f", {_STATS}" + """ SELECT run_id, 1000.0::DOUBLE AS start_balance, round(end_balance + 1e-10, 7) AS end_balance, round(net_profit + 1e-10, 7) AS net_profit, day AS start_date, day AS end_date, CAST(3600000 AS BIGINT) AS timeframe_ms, round(turnover + 1e-10, 7) AS turnover, round(fees + 1e-10, 7) AS fees, n_closed, n_win, n_loss, round(sum_win + 1e-10, 7) AS sum_win, round(sum_loss + 1e-10, 7) AS sum_loss,
 round(avg_mfe_pct + 1e-10, 7) AS avg_mfe_pct, round(avg_mae_pct + 1e-10, 7) AS avg_mae_pct, long_count, round(long_pnl + 1e-10, 7) AS long_pnl, short_count, round(short_pnl + 1e-10, 7) AS short_pnl, round(win_rate + 1e-10, 7) AS win_rate, round(long_wr + 1e-10, 7) AS long_wr, round(short_wr + 1e-10, 7) AS short_wr, round(avg_win + 1e-10, 7) AS avg_win, round(avg_loss + 1e-10, 7) AS avg_loss, round(expectancy + 1e-10, 7) AS expectancy,
 round(payoff_ratio + 1e-10, 7) AS payoff_ratio, round(sqn + 1e-10, 7) AS sqn, round(kelly_pct + 1e-10, 7) AS kelly_pct, CASE WHEN sqn >= 3 THEN 'excellent' WHEN sqn >= 2 THEN 'good' WHEN sqn >= 1.6 THEN 'average' ELSE 'poor' END AS sqn_grade, round(hold + 1e-10, 7) AS avg_hold_minutes, round(sharpe + 1e-10, 7) AS sharpe, round(sortino + 1e-10, 7) AS sortino, round(sv + 1e-10, 7) AS static_dd_val, round(spct + 1e-10, 7) AS static_dd_pct,
 round(dv + 1e-10, 7) AS dynamic_dd_val, round(dpct + 1e-10, 7) AS dynamic_dd_pct, ws AS max_win_streak, ls AS max_loss_streak, round(profit_factor + 1e-10, 7) AS profit_factor, round(calmar + 1e-10, 7) AS calmar, round(recovery_factor + 1e-10, 7) AS recovery_factor FROM stats""")
def h18_h20_h21_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    st_ = _stats(spark, sf_dir)
    return st_.select([F.round(F.col(x) + 1e-10, 7).alias(x) if t == "double" else x for x, t in st_.dtypes])


@query(_RUNS + ", n AS (SELECT run_id, round(arg_max(n_balance, seq) / 1e8 - 1000, 6) AS np FROM balanced GROUP BY run_id) SELECT count(*) AS total_runs, count(*) FILTER (np > 0) AS profitable_runs, round(count(*) FILTER (np > 0) / count(*) * 100, 4) AS profitable_pct, arg_max(run_id, (np, -run_id)) AS best_run, max(np) AS best_net_profit FROM n")
def h22_runs_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, _, runs = _ledger(spark, sf_dir)
    o = led.runs_overview(led.net_profit(ledger, runs).withColumn("net_profit", F.round("net_profit", 6)))
    return o.withColumn("profitable_pct", F.round("profitable_pct", 4))


# --- 2.9 resampling and report series ---------------------------------------------------------------------------

_OHLC = "ohlc AS (SELECT symbol, bar_start AS ts_ms, open, high, low, close FROM bars)"


def _ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.hourly_bars(spark, sf_dir).select("symbol", F.col("bar_start").alias("ts_ms"), "open", "high", "low", "close")


@query(with_(v.TRADES, v.BARS, _OHLC) + "SELECT symbol, ts_ms // 14400000 * 14400000 AS ts_ms, arg_min(open, o.ts_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, o.ts_ms) AS close, count(*) AS n_bars FROM ohlc o GROUP BY symbol, o.ts_ms // 14400000")
def i1_resample_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.resample_time(_ohlc(spark, sf_dir), 14_400_000)


@query(with_(v.TRADES, v.BARS, _OHLC) + "SELECT symbol, b AS bucket, min(ts_ms) AS ts_ms, arg_min(open, ts_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts_ms) AS close, count(*) AS n_bars FROM (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts_ms) - 1) // 8 AS b FROM ohlc) GROUP BY symbol, b")
def i2_resample_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.resample_count(_ohlc(spark, sf_dir), 8)


@query(_RUNS + """, g AS (SELECT run_id, ts_ms // 14400000 * 14400000 AS ts_ms, arg_min(open, e.ts_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, e.ts_ms) AS close, count(*) AS n_bars FROM equity e GROUP BY run_id, e.ts_ms // 14400000)
 SELECT *, round((max(high) OVER w - low) / max(high) OVER w * 100, 6) AS dd_pct, round((close - 1000) / 1000 * 100, 6) AS rel_equity_pct FROM g WINDOW w AS (PARTITION BY run_id ORDER BY ts_ms)""")
def i3_resample_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, equity, runs = _ledger(spark, sf_dir)
    return res.resample_equity(equity, 14_400_000, runs).withColumns({k: F.round(k, 6) for k in ("dd_pct", "rel_equity_pct")})


@query(with_(v.TRADES, v.BARS, _OHLC) + """, a AS (SELECT symbol, step, CASE WHEN step = 3600000 THEN o.ts_ms ELSE o.ts_ms // step * step END AS t, arg_min(open, o.ts_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, o.ts_ms) AS close FROM ohlc o, (SELECT unnest([CAST(3600000 AS BIGINT), 14400000, 86400000, 604800000]) AS step) GROUP BY ALL),
 n AS (SELECT symbol, min(step) FILTER (c <= 144) AS last FROM (SELECT symbol, step, count(*) AS c FROM a GROUP BY ALL) GROUP BY symbol) SELECT symbol, step, t AS ts_ms, open, high, low, close FROM a JOIN n USING (symbol) WHERE last IS NULL OR step <= last""")
def i4_timeframe_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.timeframe_pyramid(_ohlc(spark, sf_dir), HOUR)


@query(with_(v.TRADES, v.BARS, _OHLC) + "SELECT symbol, ts_ms, close, round((close - f) / f * 100, 6) AS rel_price_pct FROM (SELECT *, first_value(close) OVER (PARTITION BY symbol ORDER BY ts_ms) AS f FROM ohlc)")
def i5_relative_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.relative_series(_ohlc(spark, sf_dir)).select("symbol", "ts_ms", "close", r6("rel_price_pct"))


@query(_RUNS + """, p AS (SELECT run_id, min(low / 100) AS lo, max(high / 100) AS hi, arg_min(close, bar_start) / 100 AS base, min(bar_start) AS x0, max(bar_start) AS x1 FROM fills GROUP BY run_id), e AS (SELECT run_id, least(min(low), 1000) AS lo, greatest(max(high), 1000) AS hi FROM equity GROUP BY run_id),
 j AS (SELECT p.run_id, x0, x1, p.lo, p.hi, e.lo AS el, e.hi AS eh, coalesce(nullif((p.hi - p.lo) * 0.04, 0), 1) AS pp, coalesce(nullif((e.hi - e.lo) * 0.05, 0), 1) AS ep, (p.lo - base) / base * 100 AS rl, (p.hi - base) / base * 100 AS rh FROM p JOIN e USING (run_id)), k AS (SELECT *, coalesce(nullif((rh - rl) * 0.04, 0), 0.1) AS rp FROM j)
 SELECT run_id, x0, x1, round(lo - pp, 8) AS p_min, round(hi + pp, 8) AS p_max, round(el - ep, 8) AS eq_min, round(eh + ep, 8) AS eq_max, round(rl - rp, 8) AS rp_min, round(rh + rp, 8) AS rp_max, round((el - ep - 1000) / 1000 * 100, 8) AS req_min, round((eh + ep - 1000) / 1000 * 100, 8) AS req_max FROM k""")
def i6_viewport_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.run_fills(spark, sf_dir)
    bars = f.select("run_id", F.col("bar_start").alias("ts_ms"), *[(F.col(x) / 100).alias(x) for x in ("open", "high", "low", "close")])
    b = res.viewport_bounds(bars, v.run_equity(f), v.runs_of(f))
    return b.select("run_id", "x0", "x1", *[F.round(x, 8).alias(x) for x in b.columns[3:]])


@query(_RUNS + """, c AS (SELECT run_id, seq, is_open, is_long, bar_start AS candle, n_price / 100 AS price FROM fills), e AS (SELECT run_id, candle, is_long, round(avg(price), 6) AS price, count(*) AS n FROM c WHERE is_open GROUP BY ALL),
 x AS (SELECT c.run_id, candle, c.is_long, round(avg(c.price), 6) AS price, count(*) AS n, round(sum(k.pnl), 6) AS pnl, round(avg(k.pnl_pct), 6) AS pnl_pct FROM c JOIN closed k ON k.run_id = c.run_id AND k.seq = c.seq GROUP BY ALL)
 SELECT 'entry' AS kind, run_id, candle, is_long, price, n, NULL::DOUBLE AS pnl, NULL::DOUBLE AS pnl_pct FROM e UNION ALL SELECT 'exit', * FROM x""")
def i7_i8_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.run_fills(spark, sf_dir)
    ledger, bars = led.position_ledger(f, v.runs_of(f)), f.select("run_id", F.col("bar_start").alias("ts_ms"))
    none = F.lit(None).cast("double")
    e = res.entry_markers(led.opened_trades(ledger), bars, HOUR).select(F.lit("entry").alias("kind"), "run_id", "candle", "is_long", r6("price"), "n", none.alias("pnl"), none.alias("pnl_pct"))
    x = res.exit_markers(led.closed_trades(ledger), bars, HOUR).select(F.lit("exit").alias("kind"), "run_id", "candle", "is_long", r6("price"), "n", r6("pnl"), r6("pnl_pct"))
    return e.union(x)


@query(_RUNS + "SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS trade_no, 0::DOUBLE AS open_pct, round(greatest(mfe_pct, pnl_pct, 0), 6) AS high_pct, round(least(mae_pct, pnl_pct, 0), 6) + 0.0 AS low_pct, round(pnl_pct, 6) AS close_pct, 5.0::DOUBLE AS planned_tp_pct, -3.0::DOUBLE AS planned_sl_pct FROM closed")
def i9_trade_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = res.trade_excursions(led.closed_trades(_ledger(spark, sf_dir)[0]))
    return x.withColumns({"trade_no": F.col("trade_no").cast("long")} | {k: F.round(k, 6) for k in ("high_pct", "low_pct", "close_pct")})


@query(_RUNS + "SELECT run_id, ts_ms, greatest(close, 1000) AS above, least(close, 1000) AS below, close - 1000 AS profit FROM equity")
def i10_equity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, equity, runs = _ledger(spark, sf_dir)
    return res.equity_bands(equity, runs)


_NAMES = {"static_dd_val": "sv", "static_dd_pct": "spct", "dynamic_dd_val": "dv", "dynamic_dd_pct": "dpct", "max_win_streak": "ws", "max_loss_streak": "ls", "avg_hold_minutes": "hold", "start_balance": "1000.0"}
_KPIS = " UNION ALL ".join(f"SELECT run_id, '{section}' AS section, '{m}' AS metric, round(CAST({_NAMES.get(m, m)} AS DOUBLE) + 1e-10, 7) AS value FROM stats" for section, ms in res.KPIS.items() for m in ms)


@query(_RUNS + f", {_STATS} {_KPIS}")
def i11_kpi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return res.kpi_table(_stats(spark, sf_dir)).withColumn("value", F.round(F.col("value") + 1e-10, 7))


# --- 2.1 sources and stores -------------------------------------------------------------------------------------


@query(with_(v.TRADES) + "SELECT symbol, trade_id, ts_ms, n_price, n_qty * 1000 AS n_qty, is_sell, CAST(n_price AS BIGINT) AS rounded, CAST(trunc(n_price / 100 * 100) AS BIGINT) AS truncated FROM trades")
def a1_a2_csv_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, path = v.event_trades(spark, sf_dir), shared_folder(spark)
    rows = t.select("trade_id", (F.col("n_price") / 100).cast("decimal(18,2)").alias("price"), "n_qty", F.lit(0).alias("first_id"), F.lit(0).alias("last_id"), "ts_ms", "is_sell", "symbol")
    rows.write.partitionBy("symbol").option("header", True).csv(path)
    read = spark.read.schema(stores.TRADE_CSV + ", symbol string").csv(path, header=True)
    for mode, name in (("round", "rounded"), ("trunc", "truncated")):
        read = dec.scale_trades(read, 100, 1000, mode).withColumnRenamed("n_price", name)
    return dec.scale_trades(read, 100, 1000).select("symbol", "trade_id", "ts_ms", "n_price", "n_qty", "is_sell", "rounded", "truncated")


@query(with_(v.TRADES) + "SELECT symbol, trade_id, ts_ms, n_price, n_qty, is_sell FROM trades WHERE symbol = (SELECT min(symbol) FROM trades) AND ts_ms >= 1704499200000 AND ts_ms < 1705017600000")
def a3_a4_trade_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, path = v.event_trades(spark, sf_dir), shared_folder(spark)
    stores.append_trades(t.where(F.col("ts_ms") < 1_705_000_000_000 - 1_705_000_000_000 % DAY), path)
    stores.append_trades(t, path)
    first = t.agg(F.min("symbol")).first()[0]
    return stores.scan_trades(spark, path, first, "2024-01-06", "2024-01-11").select("symbol", "trade_id", "ts_ms", "n_price", "n_qty", "is_sell")


@query(with_(v.TRADES) + "SELECT symbol, CAST(epoch_ms(ts_ms) AS DATE) AS trade_date, count(*) AS n, CAST(sum(n_qty) AS BIGINT) AS qty, min(trade_id) AS first_id, max(trade_id) AS last_id FROM trades GROUP BY ALL")
def a3_partial_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that arrive in parts which overlap, some in a commit that was never published: the store has each trade once, by day."""
    t, path = v.event_trades(spark, sf_dir), shared_folder(spark)
    stores.append_trades(t.where("trade_id % 3 = 0"), path)
    t.where("trade_id % 5 = 1").withColumn("trade_date", F.to_date(s.utc_date_str("ts_ms"))).write.partitionBy("symbol", "trade_date").parquet(f"{path}/trades/commit=of-a-writer-that-died")
    stores.append_trades(t.where("trade_id % 3 <> 1"), path)
    stores.append_trades(t, path)
    by_day = stores.read_store(spark, path).groupBy("symbol", "trade_date")
    return by_day.agg(F.count(F.lit(1)).alias("n"), F.sum("n_qty").alias("qty"), F.min("trade_id").alias("first_id"), F.max("trade_id").alias("last_id"))


_DECODED = "SELECT symbol, printf('%.2f', n_price / 100) AS price, CAST(n_qty AS VARCHAR) AS qty, ts_ms, is_sell, trade_id AS agg_id, n_price, n_qty * 1000 AS n_qty FROM trades WHERE trade_id % 50 <> 7"


def _decoded(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return dec.scale_trades(dec.decode_agg_trades(dec.split_bad_messages(v.trade_messages(spark, sf_dir, kind), kind)[0], kind), 100, 1000)


@query(with_(v.TRADES) + _DECODED)
def a5_object_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "object")


@query(with_(v.TRADES) + _DECODED)
def a6_envelope_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "envelope")


@query(with_(v.TRADES) + "SELECT symbol, count(*) AS bad FROM trades WHERE trade_id % 50 = 7 GROUP BY symbol")
def a7_bad_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.split_bad_messages(v.trade_messages(spark, sf_dir, "object"), "object")[1].groupBy("symbol").agg(F.count(F.lit(1)).alias("bad"))


def _order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.event_trades(spark, sf_dir)
    i = F.col("trade_id")
    text = lambda x: x.cast("string")
    o = F.struct(
        F.col("symbol").alias("s"), F.when(i % 4 == 0, F.concat(F.lit("web_"), text(i))).otherwise(F.concat(F.lit("im_"), text(i))).alias("c"), F.when(F.col("is_sell"), "SELL").otherwise("BUY").alias("S"), F.when(i % 3 == 0, "LIMIT").otherwise("MARKET").alias("o"),
        F.element_at(F.array(*[F.lit(x) for x in ("NEW", "FILLED", "PARTIALLY_FILLED", "CANCELED", "EXPIRED")]), (i % 5 + 1).cast("int")).alias("X"), i.alias("i"), text((F.col("n_price") / 100).cast("decimal(18,2)")).alias("p"), text(F.col("n_qty")).alias("q"), F.lit("0.05").alias("n"),
        F.when(i % 2 == 0, "LONG").otherwise("SHORT").alias("ps"), F.when(i % 10 == 0, 0).otherwise(F.col("ts_ms")).alias("T"),
    )
    return t.select("trade_id", "symbol", F.to_json(F.struct(F.lit("ORDER_TRADE_UPDATE").alias("e"), F.col("ts_ms").alias("E"), o.alias("o"))).alias("message"))


@query(with_(v.TRADES) + """SELECT trade_id, symbol, ts_ms, CAST((CASE WHEN trade_id % 2 = 0 THEN 1 ELSE 2 END) + (CASE WHEN is_sell THEN 8 ELSE 4 END) + (CASE WHEN trade_id % 3 = 0 THEN 16 ELSE 32 END) + (CASE trade_id % 5 WHEN 0 THEN 128 WHEN 1 THEN 512 WHEN 2 THEN 512 ELSE 1024 END) AS BIGINT) AS order_param,
 trade_id AS order_id, CASE WHEN trade_id % 4 = 0 THEN 0 ELSE trade_id END AS client_order_id, n_price, n_qty * 1000 AS n_qty, CAST(5000000 AS BIGINT) AS n_commission FROM trades""")
def a8_order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _order_messages(spark, sf_dir).drop("symbol")
    return dec.decode_order_events(m)


def _balance_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.event_trades(spark, sf_dir)
    item = lambda a, w, k: F.struct(F.lit(a).alias("a"), w.cast("string").alias("wb"), k.cast("string").alias("cw"), F.lit("0").alias("bc"))
    b = F.array(item("BTC", F.lit(1), F.lit(1)), item("USDT", F.col("n_price"), F.col("n_price") - F.col("n_qty") + 50))
    return t.select("trade_id", F.to_json(F.struct(F.lit("ACCOUNT_UPDATE").alias("e"), F.col("ts_ms").alias("E"), F.struct(b.alias("B")).alias("a"))).alias("message"))


@query(with_(v.TRADES) + "SELECT trade_id, ts_ms, n_price * 100000000 AS n_balance, (n_price - n_qty + 50) * 100000000 AS n_available, greatest(0, n_qty - 50) * 100000000 AS n_locked FROM trades")
def a9_balance_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.decode_balance_events(_balance_messages(spark, sf_dir))


@query("SELECT p_name || p_partkey AS symbol, '0.' || repeat('0', CAST(p_partkey % 4 AS INTEGER)) || '1' AS tick_size, '0.001' AS lot_size, CAST(p_partkey % 10 + 5 AS DOUBLE) AS min_notional FROM part")
def a10_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    none = F.lit(None).cast("string")
    f = lambda kind, tick=none, step=none, least=none: F.struct(F.lit(kind).alias("filterType"), tick.alias("tickSize"), step.alias("stepSize"), least.alias("notional"))
    k = F.col("p_partkey")
    filters = F.array(f("PRICE_FILTER", tick=F.concat(F.lit("0."), F.repeat(F.lit("0"), (k % 4).cast("int")), F.lit("1"))), f("LOT_SIZE", step=F.lit("0.001")), f("MIN_NOTIONAL", least=(k % 10 + 5).cast("string")), f("MAX_NUM_ORDERS"))
    one = F.struct(F.concat("p_name", k.cast("string")).alias("symbol"), filters.alias("filters"))
    return dec.parse_instruments(p.select(F.to_json(F.struct(F.array(one).alias("symbols"))).alias("message")))


@query(with_(v.TRADES, v.BARS) + "SELECT symbol, bar_start, open, close FROM bars")
def a11_bar_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, b = shared_folder(spark), v.hourly_bars(spark, sf_dir).drop("pq", "ppq")
    stores.write_bars(b.where(F.col("bar_start") < 1_704_931_200_000), path, HOUR)
    stores.write_bars(b, path, HOUR)
    return stores.read_store(spark, path, "bars").select("symbol", "bar_start", "open", "close")


@query(with_(v.TRADES, v.BARS) + "SELECT symbol, CAST(3600000 AS BIGINT) AS timeframe_ms, CAST(epoch_ms(min(bar_start)) AS DATE) AS start_date, CAST(epoch_ms(max(bar_start)) AS DATE) AS end_date FROM bars GROUP BY symbol HAVING CAST(epoch_ms(min(bar_start)) AS DATE) <= DATE '2024-01-03' AND CAST(epoch_ms(max(bar_start)) AS DATE) >= DATE '2024-01-20'")
def a12_bar_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda x: F.date_from_unix_date(s.floor_div(x, DAY).cast("int"))
    spans = v.hourly_bars(spark, sf_dir).groupBy("symbol").agg(day(F.min("bar_start")).alias("start_date"), day(F.max("bar_start")).alias("end_date")).withColumn("timeframe_ms", F.lit(HOUR).cast("long"))
    return stores.find_bar_span(spans, "2024-01-03", "2024-01-20")


@query(with_(v.TRADES, v.BARS) + "SELECT symbol, open_time AS ts_ms, open / 100 AS open, high / 100 AS high, low / 100 AS low, close / 100 AS close FROM bars WHERE open_time BETWEEN 1704326400000 AND 1704844800000 + 86400000")
def a13_a14_bar_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.bars_to_ohlc(stores.slice_bars(v.hourly_bars(spark, sf_dir), 1_704_326_400_000, 1_704_844_800_000), 100)


@query(_RUNS + "SELECT run_id, count(*) AS fills, CAST(sum(n_commission) AS BIGINT) AS fees FROM fills GROUP BY run_id")
def a15_run_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, f = shared_folder(spark), v.run_fills(spark, sf_dir)
    fills, equity = f.drop("open", "high", "low", "close", "bar_start"), v.run_equity(f)
    stores.write_run(fills.withColumn("n_commission", F.lit(1).cast("long")), equity, path)
    stores.write_run(fills, equity, path)
    return stores.read_run_table(spark, path, "fills").groupBy("run_id").agg(F.count(F.lit(1)).alias("fills"), F.sum("n_commission").alias("fees"))


@query(_RUNS + "SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 1234.57 ELSE 1000 END::DOUBLE AS start_balance FROM (SELECT DISTINCT run_id FROM fills)")
def a16_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = v.runs_of(v.run_fills(spark, sf_dir)).select("run_id", "start_balance")
    path = shared_folder(spark)
    stores.commit_manifest(runs, path)
    stores.commit_manifest(runs.where("run_id % 2 = 0").withColumn("start_balance", F.lit(1234.567)), path)
    return stores.read_store(spark, path, "manifest")


@query(_RUNS + "SELECT run_id, ts_ms, round(open, 6) AS open, round(close, 6) AS close FROM equity")
def a17_scale_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.run_equity(v.run_fills(spark, sf_dir))
    scaled = e.select("run_id", "ts_ms", *[F.round(F.col(x) * s.MONEY).cast("long").alias(x) for x in ("open", "high", "low", "close")])
    padded = scaled.union(scaled.withColumn("ts_ms", F.lit(0).cast("long")))
    return stores.scale_equity(padded).select("run_id", "ts_ms", r6("open"), r6("close"))


# --- 2.10 streams -----------------------------------------------------------------------------------------------


def _thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = v.event_trades(spark, sf_dir)
    return t.select(F.lit("all").alias("symbol"), "trade_id", "ts_ms").where("trade_id % 97 > 2")


_GAPS = "gaps AS (SELECT 'all' AS symbol, trade_id AS after_id, n AS before_id, n - trade_id - 1 AS missing FROM (SELECT trade_id, lead(trade_id) OVER (ORDER BY trade_id) AS n FROM trades WHERE trade_id % 97 > 2) WHERE n > trade_id + 1)"


@query(with_(v.TRADES, _GAPS) + "SELECT * FROM gaps")
def k3_trade_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _thinned(spark, sf_dir)
    return st.trade_gaps(t)


@query(with_(v.TRADES, _GAPS) + "SELECT symbol, after_id, f AS from_id, least(f + 1, before_id) AS to_id FROM (SELECT *, unnest(range(after_id, before_id, 1)) AS f FROM gaps)")
def k4_gap_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _thinned(spark, sf_dir)
    return st.gap_requests(st.trade_gaps(t), 2)


@query(with_(v.TRADES, _GAPS) + "SELECT * FROM gaps WHERE before_id - after_id >= 4")
def k6_gap_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _thinned(spark, sf_dir)
    return st.gap_limit_alert(st.trade_gaps(t), 4)


@query(with_(v.TRADES, v.BARS) + "SELECT symbol, bar_start, open, high, low, close, volume, delta, n_trades, open_time, last_trade_time FROM bars")
def k1_k2_k5_k7_stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, half of them twice, and a backfill of the lost ones and some more, each a stream: decoded, merged, each trade once, and aggregated by a
    second stream; the last update of each bar."""
    folder = shared_folder(spark)
    good = dec.split_bad_messages(v.trade_messages(spark, sf_dir, "object"), "object")[0]
    lost = v.event_trades(spark, sf_dir).where("trade_id % 50 = 7")
    one = F.struct((F.col("n_price") / 100).cast("decimal(18,2)").cast("string").alias("p"), F.col("n_qty").cast("string").alias("q"), F.col("ts_ms").alias("T"), F.col("is_sell").alias("m"), F.col("trade_id").alias("a"))
    backfill = lost.select("symbol", F.to_json(one).alias("message"))
    good.unionByName(good.sample(0.5, 1)).write.parquet(f"{folder}/messages")
    backfill.unionByName(good.sample(0.1, 2)).write.parquet(f"{folder}/backfill")
    live, late = (st.stream_trades(st.read_trade_files(spark, f"{folder}/{x}", good.schema, 8), "object", 100, 1) for x in ("messages", "backfill"))
    _written(st.merge_backfill(live, late, "60 days"), f"{folder}/trades")
    written = spark.read.parquet(f"{folder}/trades")
    each = max(1, -(-len(written.inputFiles()) // 4))  # four triggers: most bars are updated more than once
    changes = _written(st.stream_bars(st.read_trade_files(spark, f"{folder}/trades", written.schema, each), HOUR, "60 days"), f"{folder}/bars", "update")
    last = changes.groupBy(*BAR).agg(F.max_by(F.struct(*[x for x in changes.columns if x not in BAR]), "n_trades").alias("b"))
    return last.select(*BAR, "b.*").drop("bar_end", "pq", "ppq")


def _written(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there, through a table."""
    w = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-state")
    w.foreachBatch(lambda df, n: df.write.mode("append").parquet(path)).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _beat(like: DataFrame, at_ms: int) -> DataFrame:
    """A heartbeat: a row without a symbol."""
    return like.sparkSession.range(1).select(*[(F.lit(at_ms) if f.name == "ts_ms" else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def _live(spark: SparkSession, sf_dir: str, slices: int = 6) -> tuple[DataFrame, str]:
    """A stream of trades from files in time order, a slice a trigger and a heartbeat at the end, and the lateness within which files of two slices may change places."""
    t, folder = v.event_trades(spark, sf_dir), shared_folder(spark)
    first, last = t.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    first, last = first or 0, last or 0
    width = (last - first) // slices + 1
    for i in range(slices):
        part = t.where(F.col("ts_ms").between(first + i * width, first + (i + 1) * width - 1)).repartition(4)
        part = part.union(_beat(t, last + 1000 * width)) if i == slices - 1 else part
        part.withColumn("ts", F.timestamp_millis("ts_ms")).write.mode("append").parquet(folder)
    return st.read_trade_files(spark, folder, spark.read.parquet(folder).schema, 4), f"{2 * width} milliseconds"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that per-symbol state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@query(_EVERYTHING + "SELECT * FROM allbars")
def k8_stream_close_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades to the whole bar table in one stream: cells, bars, and per-symbol state; the end of a symbol's last session is open, as in the batch table."""
    live, delay = _live(spark, sf_dir)
    with _rocksdb(spark):
        return _written(st.stream_close_bars(st.stream_profiled_bars(live, HOUR, SCALE, delay), HOUR, SCALE, N), shared_folder(spark))


@query(with_(v.TRADES, v.BARS) + "SELECT symbol, bar_start, close, delta FROM bars WHERE abs(delta) * 2 > volume")
def k9_stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, delay = _live(spark, sf_dir)
    return _written(st.stream_signals(st.stream_profiled_bars(live, HOUR, SCALE, delay), F.abs("delta") * 2 > F.col("volume"), [*BAR, "close", "delta"]), shared_folder(spark))


@query(_EVERYTHING + "SELECT symbol, bar_start, close, vwap, atr, session_poc, CASE WHEN close < vwap_low THEN 1 ELSE 2 END AS side FROM allbars WHERE n_trades > 0 AND bar_idx > 2 AND high - low < 2 * atr AND (close < vwap_low OR close > vwap_up OR close = session_poc)")
def k7_k9_trades_to_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades to signals in one stream, with a rule on session indicators and value areas."""
    live, delay = _live(spark, sf_dir)
    c_ = F.col
    rule = (c_("n_trades") > 0) & (c_("bar_idx") > 2) & (c_("high") - c_("low") < 2 * c_("atr")) & ((c_("close") < c_("vwap_low")) | (c_("close") > c_("vwap_up")) | (c_("close") == c_("session_poc")))
    side = F.when(c_("close") < c_("vwap_low"), 1).otherwise(2).alias("side")
    with _rocksdb(spark):
        closed = st.stream_close_bars(st.stream_profiled_bars(live, HOUR, SCALE, delay), HOUR, SCALE, N)
        return _written(st.stream_signals(closed, rule, [*BAR, "close", "vwap", "atr", "session_poc", side]), shared_folder(spark))


@query(with_(v.TRADES) + "SELECT 'all' AS symbol, trade_id AS after_id, n AS before_id, n - trade_id - 1 AS missing FROM (SELECT trade_id, lead(trade_id) OVER (ORDER BY trade_id) AS n FROM trades WHERE trade_id % 97 > 2 OR trade_id % 97 = 1 OR trade_id % 194 <= 2) WHERE n > trade_id + 1")
def k3_k5_stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps that a stream has reported and not taken back: ids arrive in time order, then a backfill closes half of the gaps and splits the others."""
    t, folder = v.event_trades(spark, sf_dir).select(F.lit("all").alias("symbol"), "trade_id", "ts_ms"), shared_folder(spark)
    last = t.agg(F.max("ts_ms")).first()[0] or 0
    live, late = F.expr("trade_id % 97 > 2"), F.expr("trade_id % 97 = 1 OR trade_id % 194 <= 2")
    parts = [t.where(live), _beat(t, last + HOUR), t.where(late & ~live).withColumn("ts_ms", F.lit(last + 2 * HOUR)), _beat(t, last + DAY)]
    with _rocksdb(spark):
        for part in parts:  # the stream goes on where it stopped: report, then take back and split, then report what is left
            part.withColumn("ts", F.timestamp_millis("ts_ms")).write.mode("append").parquet(f"{folder}/ids")
            changes = _written(st.stream_gaps(st.read_trade_files(spark, f"{folder}/ids", spark.read.parquet(f"{folder}/ids").schema, 1000)), f"{folder}/changes")
    return st.open_gaps(changes)


@query(with_(v.TRADES, v.BARS) + "SELECT symbol, bar_start, close, volume, n_trades FROM bars")
def f5_on_bar_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hook that keeps what each trigger changed, four files at a time; the last state of each bar."""
    t, folder = v.event_trades(spark, sf_dir).withColumn("ts", F.timestamp_millis("ts_ms")), shared_folder(spark)
    t.repartition(8).write.parquet(f"{folder}/trades")
    live = st.stream_bars(st.read_trade_files(spark, f"{folder}/trades", t.schema, 4), HOUR, "400 days")

    def keep(changed: DataFrame, trigger: int) -> None:
        changed.select(*BAR, "close", "volume", "n_trades", F.lit(trigger).alias("trigger")).write.mode("append").parquet(f"{folder}/changes")

    sig.on_bar_update(live, keep).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    changes = spark.read.parquet(f"{folder}/changes")
    return changes.groupBy(*BAR).agg(F.max_by(F.struct("close", "volume", "n_trades"), "trigger").alias("b")).select(*BAR, "b.*")


@query(with_(v.TRADES, v.BARS, _SIGNALS) + "SELECT symbol, count(*) AS n FROM sigs WHERE ts_ms > 1705000000000 - 60000 * 1440 GROUP BY symbol")
def k10_lag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.lag_filter(_signals(spark, sf_dir), F.lit(1_705_000_000_000), 60_000 * 1440).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(with_(v.TRADES) + """, l AS (SELECT symbol, CASE WHEN trade_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, arg_max(trade_id, (ts_ms, trade_id)) AS i, arg_max(is_sell, (ts_ms, trade_id)) AS sells FROM trades GROUP BY ALL)
 SELECT symbol, side, i AS order_id, CASE WHEN i % 5 IN (1, 2) THEN CASE WHEN opens THEN 'OPEN' ELSE 'EMPTY' END WHEN i % 5 = 0 THEN CASE WHEN opens THEN 'PENDING' ELSE 'CLOSE' END ELSE CASE WHEN opens THEN 'EMPTY' ELSE 'OPEN' END END AS state FROM (SELECT *, (side = 'LONG') <> sells AS opens FROM l)""")
def k11_account_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = dec.decode_order_events(_order_messages(spark, sf_dir).drop("symbol")).withColumns({"account": F.lit(1), "seq": F.col("trade_id")})
    balances = dec.decode_balance_events(_balance_messages(spark, sf_dir)).withColumns({"account": F.lit(1), "seq": F.col("trade_id")})
    return st.account_state(orders, balances)[0].select("symbol", "side", "order_id", "state")


@query(with_(v.TRADES) + """, l AS (SELECT CAST(trade_id % 50 AS VARCHAR) AS account, symbol, CASE WHEN trade_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, arg_max(trade_id, (ts_ms, trade_id)) AS i, arg_max(is_sell, (ts_ms, trade_id)) AS sells, max(ts_ms) AS at_ms FROM trades GROUP BY ALL),
 m AS (SELECT *, (side = 'LONG') <> sells AS opens, i % 5 = 0 AND at_ms + 21600000 <= (SELECT max(ts_ms) FROM trades) AS lapsed FROM l)
 SELECT account, symbol, side, i AS order_id, CASE WHEN i % 5 IN (1, 2) THEN CASE WHEN opens THEN 'OPEN' ELSE 'EMPTY' END WHEN i % 5 = 0 AND NOT lapsed THEN CASE WHEN opens THEN 'PENDING' ELSE 'CLOSE' END ELSE CASE WHEN opens THEN 'EMPTY' ELSE 'OPEN' END END AS state, lapsed FROM m""")
def k11_stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order events of fifty accounts in three triggers, each with events older than those before; pending orders lapse after six hours."""
    orders = dec.decode_order_events(_order_messages(spark, sf_dir).drop("symbol")).withColumns({"account": (F.col("trade_id") % 50).cast("string"), "seq": F.col("trade_id"), "ts": F.timestamp_millis("ts_ms")})
    orders = stored(orders, "orders")  # decoded once for the three parts
    last, folder = v.event_trades(spark, sf_dir).agg(F.max("ts_ms")).first()[0] or 0, shared_folder(spark)
    beat = _beat(orders.drop("ts"), last + 400 * DAY).withColumn("ts", F.timestamp_millis("ts_ms"))
    with _rocksdb(spark):
        for part in (orders.where("seq % 3 = 1"), orders.where("seq % 3 = 2"), orders.where("seq % 3 = 0"), beat):
            part.write.mode("append").parquet(f"{folder}/events")
            live = st.read_trade_files(spark, f"{folder}/events", spark.read.parquet(f"{folder}/events").schema, 1000)
            changes = _written(acc.stream_positions(live, 6 * HOUR, "400 days"), f"{folder}/changes")
    return acc.positions_now(changes).select("account", "symbol", "side", "order_id", "state", "lapsed")


_AGAIN = "again AS (SELECT order_id, symbol, exit_ts AS ts_ms, n_price, is_long, tp_bps, sl_bps FROM brackets WHERE exit_leg = 'sl'),\n " + _ORDERS[_ORDERS.index("entries AS") :].replace("entries", "entries2").replace("orders_ o", "again o")
_BRACKET2 = _BRACKET.replace("entries", "entries2").replace("legs", "legs2").replace("exits", "exits2").replace("brackets", "brackets2")


@query(with_(v.TRADES, v.BARS, _SIGNALS, _ORDERS, _BRACKET, _AGAIN, _BRACKET2) + "SELECT order_id AS chain, CAST(0 AS INTEGER) AS step, symbol, is_long, fill_ts, fill_price, exit_leg, exit_ts, exit_price FROM brackets WHERE fill_ts IS NOT NULL UNION ALL SELECT order_id, 1, symbol, is_long, fill_ts, fill_price, exit_leg, exit_ts, exit_price FROM brackets2 WHERE fill_ts IS NOT NULL")
def l2_reentry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy with hooks: a bracket for each entry, and one new entry after a stop."""
    t = v.event_trades(spark, sf_dir)
    orders = life.run_orders(_orders(spark, sf_dir), t, stored(c.bars_ohlcv(t, HOUR), "bars"), HOUR, life.Bracket(reenter=1))
    return life.round_trips(orders)

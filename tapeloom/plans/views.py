"""Inputs derived from the given tables, in Spark and as DuckDB SQL: trades, fills, equity, runs and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cells import bars_ohlcv

HOUR, DAY = 3_600_000, 86_400_000
PRICE_MULT, QTY_MULT, SCALE, BAR_COUNT = 100, 1000, 100, 24


def ntz_millis(ts: str):
    """Epoch milliseconds of a timestamp without time zone, independent of the session's zone."""
    c = F.col(ts)
    seconds = F.hour(c) * 3600 + F.minute(c) * 60
    return F.unix_date(c.cast("date")).cast("long") * DAY + seconds.cast("long") * 1000 + F.floor(F.expr(f"extract(SECOND FROM {ts})") * 1000).cast("long")


def event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from ``events``: the type is the symbol, the value the price, props the quantity, and even users sell."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("trade_id"), ntz_millis("ts").alias("ts_ms"), F.round(F.col("value") * 100).cast("long").alias("n_price"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("n_qty"), (F.col("user_id") % 2 == 0).alias("is_sell"),
    )


def item_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from ``lineitem``: ten symbols by supplier, the unit price, the shipping day. The order of a day is that of all columns."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(
        (F.col("l_suppkey") % 10).cast("string").alias("symbol"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus").alias("trade_id"),
        ntz_millis("l_shipdate").alias("ts_ms"), F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long").alias("n_price"), F.col("l_quantity").cast("long").alias("n_qty"), (F.col("l_returnflag") == "R").alias("is_sell"),
    )


TRADES = """trades AS (SELECT event_type AS symbol, event_id AS trade_id, epoch_us(ts) // 1000 AS ts_ms, CAST(round(value * 100) AS BIGINT) AS n_price,
 CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS n_qty, user_id % 2 = 0 AS is_sell FROM events)"""

BARS = """bars AS (SELECT symbol, ts_ms - ts_ms % 3600000 AS bar_start, arg_min(n_price, (ts_ms, trade_id)) AS open, max(n_price) AS high, min(n_price) AS low,
 arg_max(n_price, (ts_ms, trade_id)) AS close, CAST(sum(n_qty) AS BIGINT) AS volume, CAST(sum(CASE WHEN is_sell THEN -n_qty ELSE n_qty END) AS BIGINT) AS delta, count(*) AS n_trades,
 min(ts_ms) AS open_time, max(ts_ms) AS last_trade_time, CAST(sum(n_price * n_qty) AS HUGEINT) AS pq, CAST(sum(CAST(n_price AS HUGEINT) * n_price * n_qty) AS HUGEINT) AS ppq FROM trades GROUP BY ALL)"""

CELLS = """cells AS (SELECT symbol, ts_ms - ts_ms % 3600000 AS bar_start, CAST(ceil(n_price / 100.0) AS BIGINT) * 100 AS level, CAST(sum(CASE WHEN is_sell THEN n_qty ELSE 0 END) AS BIGINT) AS bid_qty,
 CAST(sum(CASE WHEN is_sell THEN 0 ELSE n_qty END) AS BIGINT) AS ask_qty, count(*) FILTER (is_sell) AS bid_trades, count(*) FILTER (NOT is_sell) AS ask_trades FROM trades GROUP BY ALL)"""


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_ohlcv(event_trades(spark, sf_dir), HOUR)


def run_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each symbol and day of hourly bars: odd bars open, even bars close, long and short in turn."""
    b = hourly_bars(spark, sf_dir)
    number = F.dense_rank().over(Window.orderBy("symbol"))
    names = b.select("symbol").distinct().withColumn("no", number)
    b = b.join(names, "symbol").withColumn("run_id", (F.call_function("div", F.col("bar_start"), F.lit(DAY)) - 19_000) * 100 + F.col("no"))
    b = b.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("bar_start")).cast("long"))
    opens, long = F.col("seq") % 2 == 1, F.call_function("div", F.col("seq") + 1, F.lit(2).cast("long")) % 2 == 1
    qty = F.col("run_id") % 7 * 100 + 1000
    side = F.when(long, 1).otherwise(2) + F.when(opens == long, 4).otherwise(8) + 32 + 512
    return b.select(
        "run_id", "seq", "symbol", F.col("last_trade_time").alias("ts_ms"), F.col("close").alias("n_price"), qty.alias("n_qty"), side.cast("long").alias("order_param"), F.call_function("div", F.col("close") * qty, F.lit(2).cast("long")).alias("n_commission"),
        (-(F.col("close") - F.col("low")) * qty * 1000).alias("n_mae"), ((F.col("high") - F.col("close")) * qty * 1000).alias("n_mfe"), F.lit(500).cast("long").alias("planned_tp"), F.lit(300).cast("long").alias("planned_sl"), "bar_start", "open", "high", "low", "close",
    )


FILLS = """names AS (SELECT symbol, dense_rank() OVER (ORDER BY symbol) AS no FROM (SELECT DISTINCT symbol FROM bars)),
 numbered AS (SELECT bars.*, (bar_start // 86400000 - 19000) * 100 + no AS run_id FROM bars JOIN names USING (symbol)),
 ordered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY bar_start) AS seq FROM numbered),
 fills AS (SELECT run_id, seq, symbol, last_trade_time AS ts_ms, close AS n_price, run_id % 7 * 100 + 1000 AS n_qty, seq % 2 = 1 AS is_open, ((seq + 1) // 2) % 2 = 1 AS is_long,
 (close * (run_id % 7 * 100 + 1000)) // 2 AS n_commission, -(close - low) * (run_id % 7 * 100 + 1000) * 1000 AS n_mae, (high - close) * (run_id % 7 * 100 + 1000) * 1000 AS n_mfe, bar_start, open, high, low, close FROM ordered)"""

LEDGER = """ledger AS (SELECT *, CASE WHEN is_open THEN 0 ELSE CAST(round((n_price - entry) * (CASE WHEN is_long THEN 1 ELSE -1 END) / 100 * (n_qty / 1000) * 100000000) AS BIGINT) END AS n_pnl FROM
 (SELECT *, CASE WHEN is_open THEN 0 ELSE lag(n_price) OVER (PARTITION BY run_id ORDER BY seq) END AS entry FROM fills)),
 balanced AS (SELECT *, 100000000000 + CAST(sum(n_pnl - n_commission) OVER (PARTITION BY run_id ORDER BY seq) AS BIGINT) AS n_balance FROM ledger),
 closed AS (SELECT run_id, seq, ts_ms, is_long, n_pnl / 1e8 AS pnl, n_balance / 1e8 AS balance, (CASE WHEN is_long THEN n_price / 100 - entry / 100 ELSE entry / 100 - n_price / 100 END) / (entry / 100) * 100 AS pnl_pct,
 -abs(n_mae / 1e8 / (entry / 100 * (n_qty / 1000)) * 100) AS mae_pct, abs(n_mfe / 1e8 / (entry / 100 * (n_qty / 1000)) * 100) AS mfe_pct, n_price / 100 AS price FROM balanced WHERE NOT is_open)"""

EQUITY = """equity AS (SELECT run_id, bar_start AS ts_ms, 1000 + open / 1000 AS open, 1000 + high / 1000 AS high, 1000 + low / 1000 AS low, 1000 + close / 1000 AS close FROM fills)"""


def run_equity(fills: DataFrame) -> DataFrame:
    """An equity series of each run that follows its bars, in money."""
    return fills.select("run_id", F.col("bar_start").alias("ts_ms"), *[(1000 + F.col(c) / 1000).alias(c) for c in ("open", "high", "low", "close")])


def runs_of(fills: DataFrame) -> DataFrame:
    day = F.date_from_unix_date(F.call_function("div", F.min("bar_start"), F.lit(DAY)).cast("int"))
    return fills.groupBy("run_id").agg(day.alias("start_date"), day.alias("end_date")).select("run_id", F.lit(1000.0).alias("start_balance"), "start_date", "end_date", F.lit(HOUR).cast("long").alias("timeframe_ms"))


def trade_messages(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Trade messages rendered from the trades; every 50th is cut short and does not decode."""
    t = event_trades(spark, sf_dir)
    price, qty = (F.col("n_price") / 100).cast("decimal(18,2)").cast("string"), F.col("n_qty").cast("string")
    if kind == "object":
        one = F.struct(price.alias("p"), qty.alias("q"), F.col("ts_ms").alias("T"), F.col("is_sell").alias("m"), F.col("trade_id").alias("a"))
        text = F.when(F.col("trade_id") % 3 == 0, F.to_json(F.array(one))).otherwise(F.to_json(one))
    else:
        one = F.struct(price.alias("p"), qty.alias("v"), F.when(F.col("is_sell"), "Sell").otherwise("Buy").alias("S"), F.col("ts_ms").alias("T"), F.col("trade_id").alias("a"))
        text = F.to_json(F.struct(F.lit("publicTrade").alias("topic"), F.array(one).alias("data")))
    return t.select("symbol", F.when(F.col("trade_id") % 50 == 7, F.substring(text, 1, 20)).otherwise(text).alias("message"))



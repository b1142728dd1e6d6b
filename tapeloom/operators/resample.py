"""Coarser bars and the series behind a run's report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import floor_div, rel_pct
from .ledger import dynamic_drawdown_series

# Timeframes in milliseconds with their names, and the widths in bars where time does not name them.
TIMEFRAMES = {30_000: "30s", 60_000: "1m", 300_000: "5m", 900_000: "15m", 1_800_000: "30m", 3_600_000: "1h", 14_400_000: "4h", 86_400_000: "1d", 604_800_000: "1w"}
COUNTS = (2, 4, 8, 16, 32, 64, 128)
MAX_BARS = 144


def _reduced(at: str) -> list:
    return [F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close")]


def resample_time(bars: DataFrame, step: int, keys: list[str] | None = None) -> DataFrame:
    """Epoch-aligned buckets of ``step`` ms over bars with ``ts_ms, open, high, low, close``."""
    bucket = floor_div("ts_ms", step) * step
    return bars.withColumn("_b", bucket).groupBy(*(keys or ["symbol"]), "_b").agg(*_reduced("ts_ms"), F.count(F.lit(1)).alias("n_bars")).withColumnRenamed("_b", "ts_ms")


def resample_count(bars: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """Every ``n`` bars; the bucket's time is that of its first bar."""
    keys = keys or ["symbol"]
    i = F.row_number().over(Window.partitionBy(*keys).orderBy("ts_ms")) - 1
    numbered = bars.withColumn("bucket", floor_div(i, n))
    return numbered.groupBy(*keys, "bucket").agg(F.min("ts_ms").alias("first_ts"), *_reduced("ts_ms"), F.count(F.lit(1)).alias("n_bars")).withColumnRenamed("first_ts", "ts_ms")


def resample_equity(equity: DataFrame, step: int, runs: DataFrame) -> DataFrame:
    """Equity on the same buckets, with the dynamic drawdown of the coarser series and the % against the start balance."""
    coarse = resample_time(equity.where("ts_ms > 0"), step, ["run_id"])
    dd = dynamic_drawdown_series(coarse).select("run_id", F.col("seq").alias("ts_ms"), "dd_pct")
    joined = coarse.join(dd, ["run_id", "ts_ms"]).join(runs.select("run_id", "start_balance"), "run_id")
    return joined.withColumn("rel_equity_pct", rel_pct("close", "start_balance")).drop("start_balance")


def timeframe_pyramid(bars: DataFrame, base_ms: int, max_bars: int = MAX_BARS) -> DataFrame:
    """The base bars and ever coarser timeframes, up to the first with at most ``max_bars`` bars, for each symbol; all in one pass."""
    steps = [base_ms, *[t for t in TIMEFRAMES if t > base_ms]]
    wide = bars.select("symbol", "ts_ms", "open", "high", "low", "close", F.explode(F.array(*[F.lit(s).cast("long") for s in steps])).alias("step"))
    bucket = F.when(F.col("step") == base_ms, F.col("ts_ms")).otherwise(floor_div("ts_ms", "step") * F.col("step"))
    all_ = wide.withColumn("_b", bucket).groupBy("symbol", "step", "_b").agg(*_reduced("ts_ms")).withColumnRenamed("_b", "ts_ms")
    sizes = all_.groupBy("symbol", "step").agg(F.count(F.lit(1)).alias("n"))
    enough = sizes.groupBy("symbol").agg(F.min(F.when(F.col("n") <= max_bars, F.col("step"))).alias("_last"))
    return all_.join(enough, "symbol").where("_last IS NULL OR step <= _last").drop("_last")


def relative_series(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Close as % of the first close of the series."""
    first = F.first("close").over(Window.partitionBy(*(keys or ["symbol"])).orderBy("ts_ms"))
    return bars.withColumn("rel_price_pct", rel_pct(F.col("close"), first))


def viewport_bounds(bars: DataFrame, equity: DataFrame, runs: DataFrame, max_bars: int = MAX_BARS) -> DataFrame:
    """Padded price range of the last bars and equity range of a run, and both as %.

    ``bars`` carry run_id; 4 % is added to either end of prices, 5 % to equity.
    """
    newest = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("ts_ms")))
    recent = bars.withColumn("_r", newest)
    p = recent.groupBy("run_id").agg(
        F.min(F.when(F.col("_r") <= max_bars, F.col("low"))).alias("p_lo"), F.max(F.when(F.col("_r") <= max_bars, F.col("high"))).alias("p_hi"), F.min_by("close", "ts_ms").alias("base_p"),
        F.min(F.when(F.col("_r") <= max_bars, F.col("ts_ms"))).alias("x0"), F.max("ts_ms").alias("x1"),
    )
    e = equity.where("ts_ms > 0").groupBy("run_id").agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    j = p.join(e, "run_id").join(runs.select("run_id", "start_balance"), "run_id")
    j = j.withColumns({"eq_lo": F.least("_lo", "start_balance"), "eq_hi": F.greatest("_hi", "start_balance")})
    pad = lambda lo, hi, share, least: F.coalesce(F.nullif((F.col(hi) - F.col(lo)) * share, F.lit(0.0)), F.lit(least))
    j = j.withColumns({"p_pad": pad("p_lo", "p_hi", 0.04, 1.0), "eq_pad": pad("eq_lo", "eq_hi", 0.05, 1.0), "rp_lo": rel_pct("p_lo", "base_p"), "rp_hi": rel_pct("p_hi", "base_p")})
    j = j.withColumn("rp_pad", pad("rp_lo", "rp_hi", 0.04, 0.1))
    c = F.col
    return j.select(
        "run_id", "x0", "x1", (c("p_lo") - c("p_pad")).alias("p_min"), (c("p_hi") + c("p_pad")).alias("p_max"), (c("eq_lo") - c("eq_pad")).alias("eq_min"), (c("eq_hi") + c("eq_pad")).alias("eq_max"),
        (c("rp_lo") - c("rp_pad")).alias("rp_min"), (c("rp_hi") + c("rp_pad")).alias("rp_max"), rel_pct(c("eq_lo") - c("eq_pad"), c("start_balance")).alias("req_min"), rel_pct(c("eq_hi") + c("eq_pad"), c("start_balance")).alias("req_max"),
    )


def _on_candles(trades: DataFrame, bars: DataFrame, tf: int) -> DataFrame:
    """Trades with ``candle``: the last bar at or before, clipped to the run's first and last bar."""
    ends = bars.groupBy("run_id").agg(F.min("ts_ms").alias("_a"), F.max("ts_ms").alias("_b"))
    return trades.join(ends, "run_id").withColumn("candle", F.greatest("_a", F.least("_b", floor_div("ts_ms", tf) * tf))).drop("_a", "_b")


def entry_markers(opened: DataFrame, bars: DataFrame, tf: int) -> DataFrame:
    return _on_candles(opened, bars, tf).groupBy("run_id", "candle", "is_long").agg(F.avg("price").alias("price"), F.count(F.lit(1)).alias("n"))


def exit_markers(closed: DataFrame, bars: DataFrame, tf: int) -> DataFrame:
    return _on_candles(closed, bars, tf).groupBy("run_id", "candle", "is_long").agg(F.avg("price").alias("price"), F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"), F.avg("pnl_pct").alias("pnl_pct"))


def trade_excursions(closed: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
    zero = F.lit(0.0)
    return closed.select("run_id", number.alias("trade_no"), zero.alias("open_pct"), F.greatest("mfe_pct", "pnl_pct", zero).alias("high_pct"), F.least("mae_pct", "pnl_pct", zero).alias("low_pct"), F.col("pnl_pct").alias("close_pct"), "planned_tp_pct", "planned_sl_pct")


def equity_bands(equity: DataFrame, runs: DataFrame) -> DataFrame:
    joined = equity.where("ts_ms > 0").join(runs.select("run_id", "start_balance"), "run_id")
    return joined.select("run_id", "ts_ms", F.greatest("close", "start_balance").alias("above"), F.least("close", "start_balance").alias("below"), (F.col("close") - F.col("start_balance")).alias("profit"))


# Sections of the report and the statistics in each.
KPIS = {
    "capital": ("start_balance", "end_balance", "net_profit", "turnover", "fees"),
    "risk": ("static_dd_val", "static_dd_pct", "dynamic_dd_val", "dynamic_dd_pct", "profit_factor", "recovery_factor", "sharpe", "sortino", "calmar"),
    "dynamics": ("win_rate", "long_wr", "long_pnl", "short_wr", "short_pnl", "max_win_streak", "max_loss_streak", "sqn", "kelly_pct"),
    "edge": ("expectancy", "payoff_ratio", "avg_win", "avg_mfe_pct", "avg_loss", "avg_mae_pct", "avg_hold_minutes"),
}


def kpi_table(stats: DataFrame) -> DataFrame:
    rows = [F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for s, ms in KPIS.items() for m in ms]
    return stats.select("run_id", F.inline(F.array(*rows)))



"""Trade ledger and run statistics, over all runs at once.

Fills: ``run_id, seq, symbol, ts_ms, n_price, n_qty, order_param, n_commission, n_mae, n_mfe, planned_tp, planned_sl``.
Equity: ``run_id, ts_ms, open, high, low, close`` in money. Runs: ``run_id, start_balance, start_date, end_date, timeframe_ms``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MONEY, has_flag, is_open_order
from ..sources.scratch import stored
from .scans import ROWS, SPAN, scan

LEDGER = (
    "run_id long, symbol string, seq long, ts_ms long, n_price long, n_qty long, is_long boolean, is_buy boolean, is_open boolean, n_entry long, "
    "n_pnl long, n_commission long, n_mae long, n_mfe long, planned_tp long, planned_sl long"
)


def position_ledger(fills: DataFrame, runs: DataFrame, price_mult: int = 100, qty_mult: int = 1000) -> DataFrame:
    """Filled rows with the entry before the fill, the result of closing ones, and the run's balance after it.

    The average entry is an ordered fold per (run, symbol, side); the balance is a running sum over the run. Rows that
    are not filled are left out.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        entry = qty = 0
        entries, results = [], []
        for price, q, opens, is_long in zip(pdf["n_price"], pdf["n_qty"], pdf["is_open"], pdf["is_long"], strict=True):
            price, q = int(price), int(q)
            entries.append(entry)
            if opens:
                entry = price if qty == 0 else (entry * qty + price * q) // (qty + q)
                qty += q
                results.append(0)
            else:
                moved = price - entry if is_long else entry - price
                results.append(round(moved / price_mult * (q / qty_mult) * MONEY))
                qty -= q
                entry = entry if qty else 0
        return pdf.assign(n_entry=entries, n_pnl=results)[[c.split()[0] for c in LEDGER.split(", ")]]

    filled = fills.where(has_flag("order_param", "FILLED", "order")).select(
        "run_id", "symbol", "seq", "ts_ms", "n_price", "n_qty", has_flag("order_param", "LONG", "order").alias("is_long"), has_flag("order_param", "BUY", "order").alias("is_buy"),
        is_open_order("order_param").alias("is_open"), "n_commission", "n_mae", "n_mfe", "planned_tp", "planned_sl",
    )
    folded = filled.groupBy("run_id", "symbol", "is_long").applyInPandas(fold, LEDGER)
    start = F.bround(F.col("start_balance") * MONEY).cast("long")
    summed = scan(folded, ["run_id"], ["seq"], ROWS, {"_made": ("sum", F.col("n_pnl") - F.col("n_commission"))})
    return summed.join(runs.select("run_id", start.alias("_start")), "run_id").withColumn("n_balance", F.col("_start") + F.col("_made")).drop("_start", "_made")


def opened_trades(ledger: DataFrame, price_mult: int = 100) -> DataFrame:
    return ledger.where("is_open").select("run_id", "symbol", "seq", "ts_ms", (F.col("n_balance") / MONEY).alias("balance"), (F.col("n_price") / price_mult).alias("price"), "is_long", "is_buy")


def closed_trades(ledger: DataFrame, price_mult: int = 100, qty_mult: int = 1000) -> DataFrame:
    """Closing fills with pnl, pnl %, excursions as % of the entry notional (MAE never above 0, MFE never below), planned tp / sl %, and colour."""
    entry, price = F.nullif(F.col("n_entry"), F.lit(0)) / price_mult, F.col("n_price") / price_mult
    notional = F.nullif(entry * (F.col("n_qty") / qty_mult), F.lit(0.0))
    result = F.col("n_pnl") / MONEY
    return ledger.where("NOT is_open").select(
        "run_id", "symbol", "seq", "ts_ms", F.when(result > 0, "green").otherwise("red").alias("color"), "is_long", (F.col("n_balance") / MONEY).alias("balance"), price.alias("price"),
        result.alias("pnl"), (F.when(F.col("is_long"), price - entry).otherwise(entry - price) / entry * 100.0).alias("pnl_pct"),
        (F.col("n_mae") / MONEY).alias("mae"), (-F.abs(F.col("n_mae") / MONEY / notional * 100.0)).alias("mae_pct"),
        (F.col("n_mfe") / MONEY).alias("mfe"), F.abs(F.col("n_mfe") / MONEY / notional * 100.0).alias("mfe_pct"),
        (F.col("planned_tp") / 10_000 * 100).alias("planned_tp_pct"), (-(F.col("planned_sl") / 10_000 * 100)).alias("planned_sl_pct"),
    )


def turnover_and_fees(ledger: DataFrame, price_mult: int = 100, qty_mult: int = 1000) -> DataFrame:
    traded = F.sum(F.col("n_price").cast("decimal(20,0)") * F.col("n_qty"))
    return ledger.groupBy("run_id").agg((traded.cast("double") / (price_mult * qty_mult)).alias("turnover"), (F.sum("n_commission") / MONEY).alias("fees"))


def net_profit(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    last = ledger.groupBy("run_id").agg((F.max_by("n_balance", "seq") / MONEY).alias("end_balance"))
    joined = runs.join(last, "run_id", "left").withColumn("end_balance", F.coalesce("end_balance", "start_balance"))
    return joined.select("run_id", "start_balance", "end_balance", (F.col("end_balance") - F.col("start_balance")).alias("net_profit"))


def _part(when, value="pnl"):
    return F.coalesce(F.sum(F.when(when, F.col(value))), F.lit(0.0))


def sqn_grade(sqn):
    return F.when(sqn >= 3, "excellent").when(sqn >= 2, "good").when(sqn >= 1.6, "average").otherwise("poor")


def win_loss(closed: DataFrame) -> DataFrame:
    """Counts and sums of winners and the rest, win rate, averages, expectancy, payoff, Kelly, SQN and its grade, and the sides' figures."""
    won, long = F.col("pnl") > 0, F.col("is_long")
    base = closed.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_closed"), F.count_if(won).alias("n_win"), F.count_if(~won).alias("n_loss"), _part(won).alias("sum_win"), _part(~won).alias("sum_loss"),
        F.coalesce(F.avg(F.when(F.col("mfe_pct") > 0, F.col("mfe_pct"))), F.lit(0.0)).alias("avg_mfe_pct"), F.coalesce(F.avg(F.when(F.col("mae_pct") < 0, F.col("mae_pct"))), F.lit(0.0)).alias("avg_mae_pct"),
        F.count_if(long).alias("long_count"), F.count_if(long & won).alias("_lw"), _part(long).alias("long_pnl"), F.count_if(~long).alias("short_count"), F.count_if(~long & won).alias("_sw"), _part(~long).alias("short_pnl"),
        F.avg("pnl").alias("_mean"), F.stddev_samp("pnl").alias("_std"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100.0).otherwise(0.0)
    base = base.withColumns({"win_rate": rate("n_win", "n_closed"), "long_wr": rate("_lw", "long_count"), "short_wr": rate("_sw", "short_count")})
    base = base.withColumns({"avg_win": F.when(F.col("n_win") > 0, F.col("sum_win") / F.col("n_win")).otherwise(0.0), "avg_loss": F.when(F.col("n_loss") > 0, F.col("sum_loss") / F.col("n_loss")).otherwise(0.0)})
    w = F.col("win_rate") / 100
    base = base.withColumns({
        "expectancy": w * F.col("avg_win") - F.col("n_loss") / F.col("n_closed") * F.abs("avg_loss"),
        "payoff_ratio": F.when(F.col("avg_loss") != 0, F.abs(F.col("avg_win") / F.col("avg_loss"))).otherwise(0.0),
        "sqn": F.when((F.col("n_closed") >= 5) & (F.col("_std") > 0), F.sqrt("n_closed") * F.col("_mean") / F.col("_std")).otherwise(0.0),
    })
    kelly = F.when(F.col("payoff_ratio") > 0, (w - (1 - w) / F.col("payoff_ratio")) * 100).otherwise(0.0)
    return base.withColumns({"kelly_pct": kelly, "sqn_grade": sqn_grade(F.col("sqn"))}).drop("_lw", "_sw", "_mean", "_std")


def profit_factor(sum_win, sum_loss, fees):
    """Gross profit over the absolute gross loss after fees; without a loss the gross profit, or 1."""
    loss = F.abs(sum_loss - fees)
    return F.when(loss > 0, sum_win / loss).when(sum_win > 0, sum_win).otherwise(1.0)


def avg_hold_minutes(opened: DataFrame, closed: DataFrame) -> DataFrame:
    """Mean minutes between the i-th opening and the i-th closing fill of a run, whatever their sides."""
    nth = lambda df, name: scan(df.select("run_id", "seq", F.col("ts_ms").alias(name)), ["run_id"], ["seq"], ROWS, {"i": ("rank", "seq")})
    pairs = nth(opened, "a").drop("seq").join(nth(closed, "b").drop("seq"), ["run_id", "i"])
    return pairs.groupBy("run_id").agg(F.avg((F.col("b") - F.col("a")) / 60_000).alias("avg_hold_minutes"))


def sharpe_sortino(equity: DataFrame, runs: DataFrame) -> DataFrame:
    """Annualised mean over deviation of bar returns, and over the root mean square of the negative ones; rows with ts_ms = 0 are padding."""
    before = scan(equity.where("ts_ms > 0"), ["run_id"], ["ts_ms"], SPAN, {"_before": ("lag", "close")})
    r = before.withColumn("r", F.col("close") / F.nullif(F.col("_before"), F.lit(0)) - 1).where("r IS NOT NULL AND NOT isnan(r)")
    agg = r.groupBy("run_id").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.stddev_pop("r").alias("p"), F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") * F.col("r")))).alias("d"))
    factor = F.sqrt(F.lit(365.0 * 86_400_000) / F.col("timeframe_ms"))
    sharpe = F.when(F.col("p") > 0, F.col("m") / F.col("s") * factor).otherwise(0.0)
    sortino = F.when(F.col("p") > 0, F.when(F.col("d").isNull(), sharpe).when(F.col("d") > 0, F.col("m") / F.col("d") * factor).otherwise(0.0)).otherwise(0.0)
    return runs.select("run_id", "timeframe_ms").join(agg, "run_id", "left").select("run_id", F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"), F.coalesce(sortino, F.lit(0.0)).alias("sortino"))


def static_drawdown_series(closed: DataFrame, runs: DataFrame) -> DataFrame:
    """Running peak of the balance over closed trades, from the start balance, and the fall from it."""
    s = scan(closed.join(runs.select("run_id", "start_balance"), "run_id"), ["run_id"], ["seq"], ROWS, {"_peak": ("max", "balance")}).withColumn("peak", F.greatest("start_balance", "_peak"))
    return s.select("run_id", "seq", "balance", "peak", (F.col("peak") - F.col("balance")).alias("dd"), F.when(F.col("peak") > 0, (F.col("peak") - F.col("balance")) / F.col("peak") * 100).otherwise(0.0).alias("dd_pct"))


def dynamic_drawdown_series(equity: DataFrame) -> DataFrame:
    """Running peak of the equity high against the equity low of each bar."""
    s = scan(equity.where("ts_ms > 0"), ["run_id"], ["ts_ms"], SPAN, {"peak": ("max", "high")})
    return s.select("run_id", F.col("ts_ms").alias("seq"), "peak", (F.col("peak") - F.col("low")).alias("dd"), F.when(F.col("peak") > 0, (F.col("peak") - F.col("low")) / F.col("peak") * 100).otherwise(0.0).alias("dd_pct"))


def max_drawdown(series: DataFrame, prefix: str) -> DataFrame:
    """The greatest percentage and the value at it, the first on a tie."""
    best = F.max_by("dd", F.struct("dd_pct", -F.col("seq")))
    return series.groupBy("run_id").agg(best.alias(f"{prefix}_val"), F.max("dd_pct").alias(f"{prefix}_pct"))


def streaks(closed: DataFrame) -> DataFrame:
    """Longest runs of wins and of losses; a zero result ends both."""
    sided = scan(closed.select("run_id", "seq", F.signum("pnl").alias("side")), ["run_id"], ["seq"], ROWS, {"_before": ("lag", "side")})
    turns = sided.withColumn("_turn", (F.col("_before").isNotNull() & (F.col("_before") != F.col("side"))).cast("long"))
    islands = scan(turns, ["run_id"], ["seq"], ROWS, {"island": ("sum", "_turn")})
    runs = islands.groupBy("run_id", "side", "island").agg(F.count(F.lit(1)).alias("n"))
    longest = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("n"))), F.lit(0).cast("long"))
    return runs.groupBy("run_id").agg(longest(1).alias("max_win_streak"), longest(-1).alias("max_loss_streak"))


def calmar(net, start, dd_pct, days):
    return F.when(dd_pct > 0, net / start * (365.0 / days) * 100.0 / dd_pct).otherwise(0.0)


def recovery_factor(net, dynamic, static):
    """Net profit over the dynamic drawdown, or the static one where that is 0; 0 without either."""
    return F.when(dynamic > 0, net / dynamic).when(static > 0, net / static).otherwise(0.0)


def run_stats(fills: DataFrame, equity: DataFrame, runs: DataFrame, price_mult: int = 100, qty_mult: int = 1000) -> DataFrame:
    """One wide row of statistics for each run; a run without closed trades has zeros, and the grade that an SQN of 0 has."""
    ledger = stored(position_ledger(fills, runs, price_mult, qty_mult), "ledger")
    opened, closed = opened_trades(ledger, price_mult), closed_trades(ledger, price_mult, qty_mult)
    out = net_profit(ledger, runs).join(runs.drop("start_balance"), "run_id")
    parts = [
        turnover_and_fees(ledger, price_mult, qty_mult), win_loss(closed), avg_hold_minutes(opened, closed), sharpe_sortino(equity, runs), max_drawdown(static_drawdown_series(closed, runs), "static_dd"),
        max_drawdown(dynamic_drawdown_series(equity), "dynamic_dd"), streaks(closed),
    ]
    for part in parts:
        out = out.join(part, "run_id", "left")
    out = out.fillna(0)
    c = F.col
    days = F.greatest(F.lit(1), F.datediff(c("end_date").cast("date"), c("start_date").cast("date")) + 1)
    return out.withColumns({
        "profit_factor": profit_factor(c("sum_win"), c("sum_loss"), c("fees")), "calmar": calmar(c("net_profit"), c("start_balance"), c("static_dd_pct"), days),
        "recovery_factor": recovery_factor(c("net_profit"), c("dynamic_dd_val"), c("static_dd_val")), "sqn_grade": sqn_grade(c("sqn")),
    })


def runs_overview(runs: DataFrame) -> DataFrame:
    """Number of runs, of profitable ones and their share, and the best run."""
    good = F.count_if(F.col("net_profit") > 0)
    return runs.agg(F.count(F.lit(1)).alias("total_runs"), good.alias("profitable_runs"), (good / F.count(F.lit(1)) * 100).alias("profitable_pct"), F.max_by("run_id", F.struct("net_profit", -F.col("run_id"))).alias("best_run"), F.max("net_profit").alias("best_net_profit"))

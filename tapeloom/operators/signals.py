"""Signals: user rules on closed bars.

A rule is a Column predicate, or a pandas function per (symbol, session) through ``on_bar_close``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CELL_FLAGS, ORDER_FLAGS
from .scans import SPAN, scan


class Rule(Protocol):
    """A user strategy: signals from bars with indicators and flagged cells."""

    def __call__(self, bars: DataFrame, cells: DataFrame) -> DataFrame: ...


def signals(bars: DataFrame, rule: Column, price: Column | str, is_long: Column | bool, is_limit: Column | bool = True, tp_bps: Column | int = 0, sl_bps: Column | int = 0, default_bps: int = 500) -> DataFrame:
    """``symbol, ts_ms, n_price, order_param, tp_bps, sl_bps`` of bars that meet ``rule``; 0 takes the default distance. The time is the
    bar's last trade."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    is_long, is_limit, tp_bps, sl_bps = map(as_column, (is_long, is_limit, tp_bps, sl_bps))
    side = F.when(is_long, ORDER_FLAGS["LONG"] + ORDER_FLAGS["BUY"]).otherwise(ORDER_FLAGS["SHORT"] + ORDER_FLAGS["SELL"])
    kind = F.when(is_limit, ORDER_FLAGS["LIMIT"]).otherwise(ORDER_FLAGS["MARKET"])
    distance = lambda x: F.when(x == 0, default_bps).otherwise(x).cast("long")
    price = F.col(price) if isinstance(price, str) else price
    return bars.where(rule & (F.col("n_trades") > 0)).select(
        "symbol", F.col("last_trade_time").alias("ts_ms"), price.cast("long").alias("n_price"), (side + kind + ORDER_FLAGS["NEW"]).cast("long").alias("order_param"),
        distance(tp_bps).alias("tp_bps"), distance(sl_bps).alias("sl_bps"),
    )


def number_signals(df: DataFrame, run: list[str] | None = None) -> DataFrame:
    """``signal_id`` from 1 in time order within a run."""
    return scan(df, run or ["symbol"], ["ts_ms", "n_price", "order_param"], SPAN, {"signal_id": ("rank", "ts_ms")})


def trapped_orders_rule(bars: DataFrame, flags: DataFrame, least_atr: float = 0.0025, least_bars: int = 22) -> DataFrame:
    """The sample strategy: a close on the far side of the POC from which a big cluster was traded at or beyond the POC.

    Short when the upper band is above the POC and the POC above the close, with a big ask cluster; long in the mirrored
    case, with a big bid cluster. Take profit at 2 ATR, stop at 4 ATR.
    """
    bit = CELL_FLAGS["BIG_CLUSTER"]
    big = flags.withColumns({"_bid": F.col("bid_flags").bitwiseAND(F.lit(bit)) != 0, "_ask": F.col("ask_flags").bitwiseAND(F.lit(bit)) != 0}).where("_bid OR _ask")
    marks = bars.select("symbol", "bar_start", "poc").join(big, ["symbol", "bar_start"]).where("level >= poc")
    sides = marks.groupBy("symbol", "bar_start").agg(F.bool_or("_bid").alias("big_bid"), F.bool_or("_ask").alias("big_ask"))
    atr_pct = (F.col("atr") + F.col("close")) / F.nullif("close", F.lit(0)) - 1
    able = bars.join(sides, ["symbol", "bar_start"]).withColumn("_atr", atr_pct).where((F.col("bar_idx") > least_bars) & (F.col("_atr") >= least_atr))
    short = (F.col("vwap_up") > F.col("poc")) & (F.col("poc") > F.col("close")) & F.col("big_ask")
    long = (F.col("close") > F.col("poc")) & (F.col("poc") > F.col("vwap_low")) & F.col("big_bid")
    bps = lambda k: F.bround(F.col("_atr") * 10_000 * k).cast("long")
    return signals(able, short | long, "close", long, True, bps(2), bps(4))


def on_bar_close(bars: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` on the closed bars of each (symbol, session), in order."""
    return bars.groupBy("symbol", "session_no").applyInPandas(lambda pdf: fn(pdf.sort_values("bar_start")), schema)


def on_bar_update(stream: DataFrame, fn: Callable[[DataFrame, int], None]):
    """A stream writer that calls ``fn`` with the bars that each trigger changed."""
    return stream.writeStream.outputMode("update").foreachBatch(fn)

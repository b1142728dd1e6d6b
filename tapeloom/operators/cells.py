"""Cells and bars from trades, and profiles over cells.

Trades: ``symbol, trade_id, ts_ms, n_price, n_qty, is_sell``. Every aggregation over trades is keyed by (symbol, bar[, level]), so it is
combined before the one shuffle and no symbol's history meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bar_start, price_level, signed_qty

BAR = ["symbol", "bar_start"]


def footprint_cells(trades: DataFrame, tf: int | Column, scale: int | Column, keys: list[str] | None = None) -> DataFrame:
    """``bid_qty, ask_qty, bid_trades, ask_trades`` for each bar and level. Sells are on the bid."""
    sell, qty = F.col("is_sell"), F.col("n_qty")
    return trades.groupBy(*(keys or []), "symbol", bar_start("ts_ms", tf).alias("bar_start"), price_level("n_price", scale).alias("level")).agg(
        F.sum(F.when(sell, qty).otherwise(0)).alias("bid_qty"), F.sum(F.when(sell, 0).otherwise(qty)).alias("ask_qty"),
        F.count_if(sell).alias("bid_trades"), F.count_if(~sell).alias("ask_trades"),
    )


def cell_trade_counts(trades: DataFrame, tf: int, scale: int) -> DataFrame:
    return footprint_cells(trades, tf, scale).select(*BAR, "level", "bid_trades", "ask_trades")


def bars_ohlcv(trades: DataFrame, tf: int | Column, keys: list[str] | None = None) -> DataFrame:
    """OHLC, volume, delta, trade count, first and last trade time of each bar; open and close follow (ts_ms, trade_id)."""
    at = F.struct("ts_ms", "trade_id")
    return trades.groupBy(*(keys or []), "symbol", bar_start("ts_ms", tf).alias("bar_start")).agg(
        F.min_by("n_price", at).alias("open"), F.max("n_price").alias("high"), F.min("n_price").alias("low"), F.max_by("n_price", at).alias("close"),
        F.sum("n_qty").alias("volume"), F.sum(signed_qty("n_qty", "is_sell")).alias("delta"), F.count(F.lit(1)).alias("n_trades"),
        F.min("ts_ms").alias("open_time"), F.max("ts_ms").alias("last_trade_time"),
        F.sum(F.col("n_price").cast("decimal(20,0)") * F.col("n_qty")).alias("pq"),
        F.sum((F.col("n_price").cast("decimal(19,0)") * F.col("n_price").cast("decimal(19,0)")).cast("decimal(28,0)") * F.col("n_qty").cast("decimal(9,0)")).alias("ppq"),
    )


def multi_timeframe_bars(trades: DataFrame, tfs: list[int]) -> DataFrame:
    """Bars of several timeframes from one scan: each trade is expanded by the short list of timeframes."""
    wide = trades.withColumn("tf", F.explode(F.array(*[F.lit(t).cast("long") for t in tfs])))
    return bars_ohlcv(wide, F.col("tf"), ["tf"])


def bar_volume_profile(cells: DataFrame) -> DataFrame:
    return cells.select(*BAR, "level", (F.col("bid_qty") + F.col("ask_qty")).alias("volume"))


def bar_delta_profile(cells: DataFrame) -> DataFrame:
    return cells.select(*BAR, "level", (F.col("ask_qty") - F.col("bid_qty")).alias("delta"))


def session_profiles(cells: DataFrame) -> DataFrame:
    """Volume, delta and trade count of each level over a whole session (``session_no`` on the cells)."""
    return cells.groupBy("symbol", "session_no", "level").agg(
        F.sum(F.col("bid_qty") + F.col("ask_qty")).alias("volume"), F.sum(F.col("ask_qty") - F.col("bid_qty")).alias("delta"),
        F.sum(F.col("bid_trades") + F.col("ask_trades")).alias("trades"),
    )


def session_volume_profile(cells: DataFrame) -> DataFrame:
    return session_profiles(cells).select("symbol", "session_no", "level", "volume")


def session_delta_profile(cells: DataFrame) -> DataFrame:
    return session_profiles(cells).select("symbol", "session_no", "level", "delta")


def session_trade_profile(cells: DataFrame) -> DataFrame:
    return session_profiles(cells).select("symbol", "session_no", "level", "trades")


def running_profile(cells: DataFrame, bars: DataFrame) -> DataFrame:
    """Session volume and delta of each level as of each bar's close, also for levels that the bar did not trade.

    ``bars`` lists the (symbol, session_no, bar_start) to report. The cells of a session are joined to its bars (at most bar_count),
    so work is levels x bars of one session.
    """
    own = cells.select("symbol", "session_no", "level", F.col("bar_start").alias("at"), "bid_qty", "ask_qty")
    asked = bars.select("symbol", "session_no", "bar_start")
    both = asked.join(own, ["symbol", "session_no"]).where("at <= bar_start")
    return both.groupBy("symbol", "session_no", "bar_start", "level").agg(F.sum(F.col("bid_qty") + F.col("ask_qty")).alias("volume"), F.sum(F.col("ask_qty") - F.col("bid_qty")).alias("delta"))


def poc(profile: DataFrame, keys: list[str]) -> DataFrame:
    """The level of greatest volume of each group, the highest level on a tie."""
    return profile.groupBy(*keys).agg(F.max_by("level", F.struct("volume", "level")).alias("poc"))


def value_area(profile: DataFrame, keys: list[str], scale: int, open_edges: bool = False) -> DataFrame:
    """``poc, vah, val`` of each group: from the POC towards the larger neighbour, both on a tie, until 70 % of the volume.

    Levels without volume between the highest and lowest count as 0; they are passed in stretches, so work goes with the traded levels alone. With ``open_edges`` a tie moves both sides without a range test,
    as on a grid that extends beyond the traded levels.
    """
    listed = profile.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level", "volume"))).alias("ls"))
    # the traded levels, the highest first, by their distance from the top; a stretch of untraded levels is passed in one step, however wide
    sparse = listed.select(*keys, F.expr("ls[size(ls) - 1].level").alias("top"), F.expr(f"(ls[size(ls) - 1].level - ls[0].level) div {scale} + 1").alias("n"), "ls")
    sparse = sparse.withColumn("p", F.expr(f"transform(filter(reverse(ls), x -> x.volume > 0), x -> named_struct('i', (top - x.level) div {scale}, 'q', x.volume))"))
    sparse = sparse.withColumn("tot", F.expr("aggregate(p, 0L, (a, x) -> a + x.q)")).withColumn("c", F.expr("cast(coalesce(array_position(p.q, array_max(p.q)), 1) AS int) - 1"))
    up, down = "if(s.iu >= 0 AND s.u = get(p, s.iu).i, get(p, s.iu).q, 0L)", "if(s.id < size(p) AND s.d = get(p, s.id).i, get(p, s.id).q, 0L)"
    gap = "least(if(s.iu >= 0, s.u - get(p, s.iu).i, NULL), if(s.id < size(p), get(p, s.id).i - s.d, NULL))"
    state = "named_struct('u', {}, 'd', {}, 'iu', {}, 'id', {}, 'cur', {})".format
    jump = state("s.u - GAP", "s.d + GAP", "s.iu", "s.id", "s.cur") if open_edges else state("greatest(s.u - GAP, -1L)", "least(s.d + GAP, n)", "s.iu", "s.id", "s.cur")
    go_up, go_down = state("s.u - 1", "s.d", "s.iu - 1", "s.id", "s.cur + UP"), state("s.u", "s.d + 1", "s.iu", "s.id + 1", "s.cur + DOWN")
    both = state("s.u - 1", "s.d + 1", "s.iu - 1", "s.id + 1", "s.cur + UP + DOWN")
    step = f"CASE WHEN s.cur * 10 >= tot * 7 THEN s WHEN UP > DOWN THEN {go_up} WHEN DOWN > UP THEN {go_down} WHEN UP > 0 THEN {both} ELSE {jump} END"
    step = step.replace("GAP", gap).replace("UP", up).replace("DOWN", down)
    first = state("coalesce(get(p, c).i, 0L) - 1", "coalesce(get(p, c).i, 0L) + 1", "c - 1", "c + 1", "coalesce(get(p, c).q, 0L)")
    found = sparse.withColumn("s", F.expr(f"aggregate(sequence(1, greatest(1, 2 * size(p))), {first}, (s, i) -> {step})"))
    price = lambda index: (F.col("top") - index * scale).cast("long")
    return found.select(*keys, price(F.expr("coalesce(get(p, c).i, 0L)")).alias("poc"), price(F.col("s.u") + 1).alias("vah"), price(F.col("s.d") - 1).alias("val"))


def qty_at(cells: DataFrame, bars: DataFrame, price_col: str) -> DataFrame:
    """Bid, ask, sum and delta at the level ``price_col`` of each bar; 0 where that level did not trade."""
    own = cells.select(*BAR, F.col("level").alias("_level"), "bid_qty", "ask_qty")
    asked = bars.select(*BAR, F.col(price_col).alias("_level"))
    joined = asked.join(own, [*BAR, "_level"], "left")
    bid, ask = F.coalesce("bid_qty", F.lit(0)), F.coalesce("ask_qty", F.lit(0))
    return joined.select(*BAR, F.col("_level").alias("level"), bid.alias("bid"), ask.alias("ask"), (bid + ask).alias("sum"), (ask - bid).alias("delta"))


def session_qty_at(profile: DataFrame, volume: str = "volume", delta: str = "delta") -> DataFrame:
    """``bid`` and ``ask`` of session levels from volume and delta."""
    bid = F.call_function("div", F.col(volume) - F.col(delta), F.lit(2).cast("long"))
    return profile.withColumns({"bid": bid, "ask": F.col(volume) - bid})


def bar_slice(cells: DataFrame, bars: DataFrame, scale: int) -> DataFrame:
    """The cells between the levels of their bar's low and high."""
    ends = bars.select(*BAR, price_level("low", scale).alias("_lo"), price_level("high", scale).alias("_hi"))
    return cells.join(ends, BAR).where(F.col("level").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def session_last(bars: DataFrame, columns: list[str]) -> DataFrame:
    """The last bar's ``columns`` of each session."""
    return bars.groupBy("symbol", "session_no").agg(F.max_by(F.struct(*columns), "bar_start").alias("l")).select("symbol", "session_no", "l.*")

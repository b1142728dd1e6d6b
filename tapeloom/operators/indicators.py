"""Sessions, filled bars, and indicators in bar order.

These run on bars, which are few beside trades (2,880 a day at 30 s). Windows are partitioned by (symbol, session), and those that cross
sessions by blocks of a symbol's bars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import floor_div
from ..sources.scratch import stored
from .scans import follow, next_point_by_blocks

#: About so many bars make a block in which chained sessions are followed.
BLOCK_BARS = 8192
SESSION = ["symbol", "session_no"]


def assign_sessions(bars: DataFrame, tf: int, bar_count: int, mode: str = "chained") -> DataFrame:
    """``session_no, session_start, bar_idx`` for bars with trades.

    chained: a session opens at the first bar at or after the end of the last one, so that it depends on the data: each bar points to the one that would
    open the next session, and the chain from a symbol's first bar is followed by blocks of about ``BLOCK_BARS`` bars. anchored: sessions are whole multiples of bar_count
    bars from a symbol's first bar.
    """
    length = tf * bar_count
    if mode == "anchored":
        first = bars.groupBy("symbol").agg(F.min("bar_start").alias("_first"))
        number = floor_div(F.col("bar_start") - F.col("_first"), length)
        out = bars.join(first, "symbol").withColumn("session_no", number).withColumn("session_start", F.col("_first") + F.col("session_no") * length).drop("_first")
    else:
        bars = stored(bars, "bars")
        at, width = bars.select("symbol", "bar_start").distinct(), max(1, BLOCK_BARS // bar_count) * length
        asks = at.select("symbol", (F.col("bar_start") + length).alias("at"), F.col("bar_start").alias("ask"))
        to = next_point_by_blocks(asks, at.select("symbol", F.col("bar_start").alias("at"), F.struct("bar_start").alias("t")), ["symbol"], width, True)
        pointers = to.select("symbol", F.struct(F.col("ask").alias("bar_start")).alias("at"), F.col("ask").alias("place"), F.col("t").alias("next"), F.col("t.bar_start").alias("next_place"))
        starts = follow(pointers, ["symbol"], width)
        starts = starts.select("symbol", F.col("at.bar_start").alias("session_start"), F.col("no").alias("session_no"))
        near = floor_div("session_start", length)
        starts = starts.withColumn("_near", F.explode(F.array(near, near + 1)))
        within = (F.col("session_start") <= F.col("bar_start")) & (F.col("bar_start") < F.col("session_start") + length)
        out = bars.withColumn("_near", floor_div("bar_start", length)).join(starts, ["symbol", "_near"]).where(within).drop("_near")
        out = out.select(*[c for c in bars.columns if c not in ("session_no", "session_start")], "session_no", "session_start")
    return out.withColumn("bar_idx", F.call_function("div", F.col("bar_start") - F.col("session_start"), F.lit(tf).cast("long")))


def fill_missing_bars(bars: DataFrame, tf: int, bar_count: int | None = None) -> DataFrame:
    """Bars without trades between the first and last of a session: the previous close as OHLC, zero volume, aligned time.

    With ``bar_count`` all sessions but a symbol's last are filled to their end. ``is_filled`` marks such rows.
    """
    ends = bars.groupBy(*SESSION, "session_start").agg(F.max("bar_start").alias("last"))
    if bar_count:
        newest = F.max("session_no").over(Window.partitionBy("symbol"))
        ends = ends.withColumn("last", F.when(F.col("session_no") < newest, F.col("session_start") + (bar_count - 1) * tf).otherwise(F.col("last")))
    frame = ends.select(*SESSION, "session_start", F.explode(F.sequence("session_start", "last", F.lit(tf).cast("long"))).alias("bar_start"))
    joined = frame.join(bars.drop("session_start"), [*SESSION, "bar_start"], "left")
    before = Window.partitionBy(*SESSION).orderBy("bar_start").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last("close", ignorenulls=True).over(before)
    empty = F.col("n_trades").isNull()
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("volume", "delta", "n_trades", "pq", "ppq")}
    out = joined.withColumns({"is_filled": empty, "_carried": carried})
    out = out.withColumns({c: F.coalesce(c, "_carried") for c in ("open", "high", "low", "close")} | zero)
    out = out.withColumns({"open_time": F.coalesce("open_time", "bar_start"), "last_trade_time": F.coalesce("last_trade_time", "bar_start")})
    return out.withColumn("bar_idx", F.call_function("div", F.col("bar_start") - F.col("session_start"), F.lit(tf).cast("long"))).drop("_carried")


def cvd(bars: DataFrame) -> DataFrame:
    over = Window.partitionBy(*SESSION).orderBy("bar_start").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("cvd", F.sum("delta").over(over))


def vwap_bands(bars: DataFrame, k: int = 2) -> DataFrame:
    """Session VWAP as of each bar, and k volume-weighted deviations to either side, rounded to whole price units.

    The sums are exact decimals, so neither order nor cancellation matters.
    """
    over = Window.partitionBy(*SESSION).orderBy("bar_start").rowsBetween(Window.unboundedPreceding, 0)
    w, pq, ppq = (F.sum(c).over(over) for c in ("volume", "pq", "ppq"))
    out = bars.withColumns({"_w": w, "_pq": pq, "_ppq": ppq})
    weight = F.nullif(F.col("_w").cast("double"), F.lit(0.0))
    mean = F.col("_pq").cast("double") / weight
    spread = F.col("_ppq").cast("double") / weight - mean * mean
    deviation = F.sqrt(F.greatest(F.lit(0.0), spread))
    return out.withColumns({"vwap": F.bround(mean).cast("long"), "vwap_up": F.bround(mean + k * deviation).cast("long"), "vwap_low": F.bround(mean - k * deviation).cast("long")}).drop("_w", "_pq", "_ppq")


def true_range(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(Window.partitionBy(*SESSION).orderBy("bar_start"))
    spread = F.col("high") - F.col("low")
    return bars.withColumn("true_range", F.greatest(spread, F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def parkinson_term(bars: DataFrame) -> DataFrame:
    """round(ln(high / low)^2 * 1e9); 0 where the low is 0."""
    ratio = F.ln(F.col("high") / F.nullif("low", F.lit(0)))
    return bars.withColumn("park_term", F.bround(F.coalesce(ratio * ratio * 1_000_000_000, F.lit(0.0))).cast("long"))


def smoothed(bars: DataFrame, columns: dict[str, tuple[str, int]], gap_mode: str = "carry") -> DataFrame:
    """``columns`` names outputs with their source and period: x = floor((x_before * (period - 1) + source) / period) along each session, from its
    first value.

    Filled bars carry x; with ``gap_mode='zero'`` they hold 0 and the recurrence goes on from that.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_start")
        for name, (source, period) in columns.items():
            x, values = None, []
            for value, filled in zip(pdf[source], pdf["is_filled"], strict=True):
                if filled and x is not None:
                    x = x if gap_mode == "carry" else 0
                else:
                    x = int(value) if x is None else (x * (period - 1) + int(value)) // period
                values.append(x)
            pdf[name] = values
        return pdf[["symbol", "session_no", "bar_start", *columns]]

    keyed = bars.select(*SESSION, "bar_start", "is_filled", *[source for source, _ in columns.values()])
    folded = keyed.groupBy(*SESSION).applyInPandas(fold, "symbol string, session_no long, bar_start long, " + ", ".join(f"{name} long" for name in columns))
    return bars.join(folded, [*SESSION, "bar_start"])


def atr(bars: DataFrame, period: int = 14, gap_mode: str = "carry") -> DataFrame:
    return smoothed(true_range(bars), {"atr": ("true_range", period)}, gap_mode)


def parkinson(bars: DataFrame, period: int = 12, gap_mode: str = "carry") -> DataFrame:
    return smoothed(parkinson_term(bars), {"parkinson": ("park_term", period)}, gap_mode)


def atr_and_parkinson(bars: DataFrame, atr_period: int = 14, park_period: int = 12, gap_mode: str = "carry") -> DataFrame:
    """Both in one pass over each session."""
    return smoothed(parkinson_term(true_range(bars)), {"atr": ("true_range", atr_period), "parkinson": ("park_term", park_period)}, gap_mode)


def row_blocks(bars: DataFrame, n: int, size: int = 4096) -> DataFrame:
    """``bars`` with ``_block, _rank, _own``: their order in a symbol, in blocks of ``size``, each led by copies (not ``_own``) of the ``n`` rows before.

    Ranks are those within the session and the sizes of the sessions before, so that no window sees more of a symbol than a row a session.
    """
    sizes = bars.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("symbol").orderBy("session_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*SESSION, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rank = F.col("_off") + F.row_number().over(Window.partitionBy(*SESSION).orderBy("bar_start")) - 1
    ranked = bars.join(offsets, SESSION).withColumn("_rank", rank).drop("_off")
    own = F.call_function("div", F.col("_rank"), F.lit(size).cast("long"))
    places = F.when(F.col("_rank") % size >= size - n, F.array(own, own + 1)).otherwise(F.array(own))
    return ranked.withColumn("_block", F.explode(places)).withColumn("_own", F.col("_block") == own)


def moving_averages(bars: DataFrame, n: int = 21, bar_count: int | None = None) -> DataFrame:
    """Floor means over the ``n`` rows before each bar, once there are n: volume and trade count, with filled bars as 0, and average trade
    size over the bars with trades. They cross sessions."""
    over = Window.partitionBy("symbol", "_block").orderBy("_rank").rowsBetween(-n, -1)
    enough = F.count(F.lit(1)).over(over) >= n
    size = F.when(F.col("n_trades") > 0, floor_div("volume", "n_trades"))
    mean = lambda c: floor_div(F.sum(c).over(over), F.count(c).over(over))
    return row_blocks(bars, n).withColumn("_size", size).withColumns({
        "ma_volume": F.when(enough, mean("volume")), "ma_trades": F.when(enough, mean("n_trades")),
        "ma_trade_size": F.when(enough, mean("_size")),
    }).where("_own").drop("_size", "_block", "_rank", "_own")


def ma_volume(bars: DataFrame, n: int = 21) -> DataFrame:
    return moving_averages(bars, n).drop("ma_trades", "ma_trade_size")


def ma_trade_count(bars: DataFrame, n: int = 21) -> DataFrame:
    return moving_averages(bars, n).drop("ma_volume", "ma_trade_size")


def ma_avg_trade_size(bars: DataFrame, n: int = 21) -> DataFrame:
    return moving_averages(bars, n).drop("ma_volume", "ma_trades")


def grow_area(places: np.ndarray, volumes: np.ndarray, open_edges: bool) -> tuple[int, int, int]:
    """Places of POC, upper and lower end of the value area of a profile: rising ``places`` of its levels, counted down from the highest, and their volumes.

    Levels that are not listed have no volume; stretches of them are passed in one step.
    """
    last, at = int(places[-1]), np.flatnonzero(volumes > 0)
    if not len(at):
        return int(places[0]), int(places[0]), int(places[0])
    place, volume = places[at].tolist(), volumes[at].tolist()
    i = max(range(len(volume)), key=volume.__getitem__)
    c, have, total = place[i], volume[i], sum(volume)
    u, d, above, below = c - 1, c + 1, i - 1, i + 1
    while have * 10 < total * 7:
        a = volume[above] if above >= 0 and place[above] == u else 0
        b = volume[below] if below < len(place) and place[below] == d else 0
        if not a and not b:
            step = min(([u - place[above]] if above >= 0 else []) + ([place[below] - d] if below < len(place) else []))
            u, d = (u - step, d + step) if open_edges else (max(u - step, -1), min(d + step, last + 1))
            continue
        if a >= b:
            have, u, above = have + a, u - 1, above - 1
        if b >= a:
            have, d, below = have + b, d + 1, below + 1
    return c, u + 1, d - 1


def session_value_area(cells: DataFrame, scale: int) -> DataFrame:
    """``session_poc, session_vah, session_val`` of the session's profile as of each bar with trades.

    One array per (symbol, session) holds the traded levels while its bars pass, so nothing of size levels x bars is made.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_start")
        top = int(pdf["level"].max())
        places, index = np.unique(((top - pdf["level"]) // scale).to_numpy(), return_inverse=True)
        v = np.zeros(len(places), np.int64)
        volume, bars = pdf["volume"].to_numpy(), pdf["bar_start"].to_numpy()
        rows = []
        for a, b in _runs(bars):
            np.add.at(v, index[a:b], volume[a:b])
            rows.append((bars[a], *(top - i * scale for i in grow_area(places, v, True))))
        out = pd.DataFrame(rows, columns=["bar_start", "session_poc", "session_vah", "session_val"])
        return out.assign(symbol=pdf["symbol"].iloc[0], session_no=pdf["session_no"].iloc[0])[["symbol", "session_no", "bar_start", "session_poc", "session_vah", "session_val"]]

    own = cells.select(*SESSION, "bar_start", "level", (F.col("bid_qty") + F.col("ask_qty")).alias("volume"))
    return own.groupBy(*SESSION).applyInPandas(fold, "symbol string, session_no long, bar_start long, session_poc long, session_vah long, session_val long")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(values)) + 1
    yield from zip([0, *edge.tolist()], [*edge.tolist(), len(values)], strict=True)


PARKINSON_FACTOR = 1 / (4 * math.log(2))

"""The full bar table and its sessions' cells, composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import cells as c
from ..operators import indicators as i
from ..operators.flags import cell_flags
from ..sources.scratch import stored

BAR = ["symbol", "bar_start"]


def session_bars(trades: DataFrame, tf: int, bar_count: int, mode: str = "chained") -> DataFrame:
    return i.assign_sessions(c.bars_ohlcv(trades, tf), tf, bar_count, mode)


def session_cells(trades: DataFrame, bars: DataFrame, tf: int, scale: int) -> DataFrame:
    """Cells with their session_no."""
    return c.footprint_cells(trades, tf, scale).join(bars.select(*BAR, "session_no"), BAR)


def close_bars(trades: DataFrame, tf: int, scale: int, bar_count: int, mode: str = "chained", gap_mode: str = "carry", atr_period: int = 14, park_period: int = 12, ma: int = 21, k: int = 2) -> DataFrame:
    """Every bar, filled ones included, with all indicators and value areas.

    Trades are shuffled twice, by (symbol, bar) for bars and by (symbol, bar, level) for cells, both after partial aggregation; all else
    runs on bars.
    """
    return bars_and_cells(trades, tf, scale, bar_count, mode, gap_mode, atr_period, park_period, ma, k)[0]


def bars_and_cells(trades: DataFrame, tf: int, scale: int, bar_count: int, mode: str = "chained", gap_mode: str = "carry", atr_period: int = 14, park_period: int = 12, ma: int = 21, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """``close_bars``, and the written cells with their session_no that it is made from."""
    bars = stored(session_bars(trades, tf, bar_count, mode), "session-bars")
    cells = stored(session_cells(trades, bars, tf, scale), "session-cells")
    full = i.vwap_bands(i.cvd(i.fill_missing_bars(bars, tf, bar_count)), k)
    full = i.moving_averages(i.atr_and_parkinson(full, atr_period, park_period, gap_mode), ma)
    own = c.value_area(c.bar_volume_profile(cells), BAR, scale)
    session = i.session_value_area(cells, scale)
    return full.join(own, BAR, "left").join(session, ["symbol", "session_no", "bar_start"], "left").drop("pq", "ppq"), cells


def flagged_cells(trades: DataFrame, tf: int, scale: int, bar_count: int, mult: float = 0.33) -> tuple[DataFrame, DataFrame]:
    """The full bars, and all flags of each (bar, level). Bars and cells feed ten flag rules, so each is written once."""
    bars, cells = bars_and_cells(trades, tf, scale, bar_count)
    bars = stored(bars, "bars")
    return bars, cell_flags(cells, bars, scale, True, mult)

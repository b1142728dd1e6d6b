"""Flags of cells and levels: patterns as bit masks per (bar, level).

Side flags are evaluated on final cells. Marks that bars put on levels without trades are emitted as rows and combined by bit_or.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CELL_FLAGS, floor_div, price_level
from .indicators import row_blocks

BAR = ["symbol", "bar_start"]


def _bit(name: str, when: Column) -> Column:
    return F.when(when, CELL_FLAGS[name]).otherwise(0).cast("long")


def _marks(bars: DataFrame, names: dict[str, Column], side: str) -> DataFrame:
    """Rows ``symbol, bar_start, level, bid_flags, ask_flags`` for levels named by bars."""
    pairs = F.array(*[F.struct(level.cast("long").alias("level"), F.lit(CELL_FLAGS[n]).cast("long").alias("bit")) for n, level in names.items()])
    rows = bars.select(*BAR, F.inline(pairs)).where("level IS NOT NULL")
    zero = F.lit(0).cast("long")
    return rows.select(*BAR, "level", (F.col("bit") if side == "bid" else zero).alias("bid_flags"), (F.col("bit") if side == "ask" else zero).alias("ask_flags"))


Rule = tuple[str, Column, Column]


def _ohlc_levels(scale: int) -> dict[str, Column]:
    return {n.upper(): price_level(n, scale) for n in ("open", "high", "low", "close")}


def _bar_area_levels() -> dict[str, Column]:
    return {"POC_BAR": F.col("poc"), "VAH_BAR": F.col("vah"), "VAL_BAR": F.col("val")}


def _session_area_levels() -> dict[str, Column]:
    return {"POC_FP": F.col("session_poc"), "VAH_FP": F.col("session_vah"), "VAL_FP": F.col("session_val")}


def _vwap_levels(scale: int) -> dict[str, Column]:
    return {"VWAP_FP": price_level("vwap", scale), "UPPER_BAND_FP": price_level("vwap_up", scale), "LOWER_BAND_FP": price_level("vwap_low", scale)}


def flag_ohlc(bars: DataFrame, scale: int) -> DataFrame:
    return _marks(bars.where("n_trades > 0"), _ohlc_levels(scale), "bid")


def flag_bar_value_area(bars: DataFrame) -> DataFrame:
    return _marks(bars.where("n_trades > 0"), _bar_area_levels(), "bid")


def flag_session_value_area(bars: DataFrame) -> DataFrame:
    return _marks(bars.where("n_trades > 0"), _session_area_levels(), "bid")


def flag_vwap(bars: DataFrame, scale: int) -> DataFrame:
    return _marks(bars.where("n_trades > 0"), _vwap_levels(scale), "bid")


def _sided(cells: DataFrame, *rules: Rule) -> DataFrame:
    """The flags of the rules that a cell meets, one column a side."""
    bid, ask = (reduce(Column.bitwiseOR, [_bit(rule[0], rule[side]) for rule in rules]) for side in (1, 2))
    return cells.select(*BAR, "level", bid.alias("bid_flags"), ask.alias("ask_flags")).where("bid_flags <> 0 OR ask_flags <> 0")


def _zero_print() -> Rule:
    b, a = F.col("bid_qty"), F.col("ask_qty")
    return "ZERO_PRINT", (b == 0) & (a > 0), (a == 0) & (b > 0)


def _delta_domination() -> Rule:
    return "DELTA_DOMINATION", F.col("bid_qty") > F.col("ask_qty"), F.col("ask_qty") > F.col("bid_qty")


def _horizontal(ratio: int) -> Rule:
    return "IMBALANCE", F.col("bid_qty") > F.col("ask_qty") * ratio, F.col("ask_qty") > F.col("bid_qty") * ratio


def _diagonal(ratio: int) -> Rule:
    """On cells with their neighbours."""
    return "IMBALANCE", (F.col("level") < F.col("_hi")) & (F.col("bid_qty") > F.col("_up") * ratio), (F.col("level") > F.col("_lo")) & (F.col("ask_qty") > F.col("_down") * ratio)


def _big_cluster() -> Rule:
    """On cells with their bar's limit."""
    return "BIG_CLUSTER", F.col("bid_qty") > F.col("_limit"), F.col("ask_qty") > F.col("_limit")


def _level_delta() -> list[Rule]:
    """On cells with the session's delta so far at their level."""
    below, no = F.col("_delta") < 0, F.lit(False)
    return [("BID_DELTA_DOMINATION_FP", below, no), ("ASK_DELTA_DOMINATION_FP", no, ~below)]


def _with_neighbours(cells: DataFrame, scale: int) -> DataFrame:
    over = Window.partitionBy(*BAR).orderBy("level")
    whole = Window.partitionBy(*BAR)
    up = F.when(F.lead("level").over(over) == F.col("level") + scale, F.lead("ask_qty").over(over)).otherwise(0)
    down = F.when(F.lag("level").over(over) == F.col("level") - scale, F.lag("bid_qty").over(over)).otherwise(0)
    return cells.withColumns({"_up": up, "_down": down, "_hi": F.max("level").over(whole), "_lo": F.min("level").over(whole)})


def _with_session_delta(cells: DataFrame) -> DataFrame:
    over = Window.partitionBy("symbol", "session_no", "level").orderBy("bar_start").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("_delta", F.sum(F.col("ask_qty") - F.col("bid_qty")).over(over))


def _limits(bars: DataFrame, mult: float) -> DataFrame:
    """``symbol, bar_start, _limit`` from the previous row's volume average, where there is one: floor(average x mult), mult to four decimals."""
    before = F.lag("ma_volume").over(Window.partitionBy("symbol", "_block").orderBy("_rank"))
    known = row_blocks(bars.select(*BAR, "session_no", "ma_volume"), 1).withColumn("_ma", before).where("_own AND _ma > 0")
    return known.select(*BAR, floor_div(F.col("_ma") * round(mult * 10_000), 10_000).alias("_limit"))


def flag_zero_print(cells: DataFrame) -> DataFrame:
    return _sided(cells, _zero_print())


def flag_delta_domination(cells: DataFrame) -> DataFrame:
    return _sided(cells, _delta_domination())


def flag_imbalance_horizontal(cells: DataFrame, ratio: int = 3) -> DataFrame:
    return _sided(cells, _horizontal(ratio))


def flag_imbalance_diagonal(cells: DataFrame, scale: int, ratio: int = 3) -> DataFrame:
    """Bid against the ask one level up, ask against the bid one level down; not tested past the bar's high and low level."""
    return _sided(_with_neighbours(cells, scale), _diagonal(ratio))


def flag_big_cluster(cells: DataFrame, bars: DataFrame, mult: float = 0.33) -> DataFrame:
    """Side volume above floor(the previous row's volume average x mult), mult to four decimals."""
    return _sided(cells.join(_limits(bars, mult), BAR), _big_cluster())


def flag_level_delta(cells: DataFrame, bars: DataFrame) -> DataFrame:
    """The sign of the session's delta so far at each level that the bar traded; zero counts as ask. Only once there is a volume average."""
    return _sided(_with_session_delta(cells).join(_limits(bars, 1), BAR, "left_semi"), *_level_delta())


def range_nodes(low: str, high: str) -> Column:
    """The dyadic ranges of whole numbers that make up [low, high]: structs (k, i) for i * 2^k to (i + 1) * 2^k - 1, at most two a size."""
    # an odd start and an even end are nodes of this size; what is left begins and ends with whole pairs, which are nodes of the next
    odd, even = "if(pmod(s.a, 2) = 1, array(named_struct('k', k, 'i', s.a)), array())", "if(pmod(s.b, 2) = 0, array(named_struct('k', k, 'i', s.b)), array())"
    step = f"named_struct('a', (s.a + pmod(s.a, 2)) div 2, 'b', (s.b - if(pmod(s.b, 2) = 0, 2, 1)) div 2, 'out', concat(s.out, {odd}, {even}))"
    sizes = f"sequence(0, cast(ceil(log2({high} - {low} + 1)) AS int) + 1)"
    start = f"named_struct('a', {low}, 'b', {high}, 'out', cast(array() AS array<struct<k:int,i:bigint>>))"
    return F.expr(f"aggregate({sizes}, {start}, (s, k) -> if(s.a > s.b, s, {step}), s -> s.out)")


def last_cover(points: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, place, ..) with ``last``: the greatest ``at`` of the ``ranges`` (keys, low, high, at) that hold the place, null if none does.

    A tree over places: a range is the at most 2 log(width) nodes that make it up, a node knows the greatest ``at`` of its ranges, and a place asks the node of each size above it.
    No point meets a range, so work is n log n whatever the ranges are.
    """
    nodes = ranges.withColumn("n", F.explode(range_nodes("low", "high"))).groupBy(*keys, F.col("n.k").alias("_k"), F.col("n.i").alias("_i")).agg(F.max("at").alias("_at"))
    top = nodes.groupBy(*keys).agg(F.max("_k").alias("_top"))
    asked = points.select(*keys, "place").distinct().join(top, keys).withColumn("_k", F.explode(F.expr("sequence(0, _top)"))).withColumn("_i", F.expr("shiftright(place, _k)"))
    found = asked.join(nodes, [*keys, "_k", "_i"]).groupBy(*keys, "place").agg(F.max("_at").alias("last"))
    return points.join(found, [*keys, "place"], "left")


def flag_auction(cells: DataFrame, bars: DataFrame, scale: int) -> DataFrame:
    """At close: the high is FINISHED if no ask volume traded there, the low if no bid volume did; else UNFINISHED.

    A later bar of the session clears the marks on levels in its own range, so a mark stays if its own bar is the last one of the session that covers its level.
    """
    ends = bars.where("n_trades > 0").select(*BAR, "session_no", price_level("high", scale).alias("hi"), price_level("low", scale).alias("lo"))
    at = cells.select(*BAR, "level", "bid_qty", "ask_qty")
    high = ends.join(at.withColumnRenamed("level", "hi"), [*BAR, "hi"]).select(*BAR, "session_no", F.col("hi").alias("level"), F.lit("ask").alias("side"), (F.col("ask_qty") == 0).alias("finished"))
    low = ends.join(at.withColumnRenamed("level", "lo"), [*BAR, "lo"]).select(*BAR, "session_no", F.col("lo").alias("level"), F.lit("bid").alias("side"), (F.col("bid_qty") == 0).alias("finished"))
    ranges = ends.select("symbol", "session_no", floor_div("lo", scale).alias("low"), floor_div("hi", scale).alias("high"), F.col("bar_start").alias("at"))
    left = last_cover(high.union(low).withColumn("place", floor_div("level", scale)), ranges, ["symbol", "session_no"]).where("last = bar_start")
    bit = F.when(F.col("finished"), CELL_FLAGS["FINISHED_AUCTION"]).otherwise(CELL_FLAGS["UNFINISHED_AUCTION"]).cast("long")
    return left.select(*BAR, "level", F.when(F.col("side") == "bid", bit).otherwise(0).cast("long").alias("bid_flags"), F.when(F.col("side") == "ask", bit).otherwise(0).cast("long").alias("ask_flags"))


def cell_flags(cells: DataFrame, bars: DataFrame, scale: int, diagonal: bool = True, mult: float = 0.33) -> DataFrame:
    """All flags of each (bar, level); ``cells`` and ``bars`` carry session_no, ``bars`` all indicators."""
    levels = _ohlc_levels(scale) | _bar_area_levels() | _session_area_levels() | _vwap_levels(scale)
    near = _with_session_delta(_with_neighbours(cells, scale) if diagonal else cells).join(_limits(bars, mult), BAR, "left")
    known = F.col("_limit").isNotNull()
    so_far = [(name, known & bid, known & ask) for name, bid, ask in _level_delta()]
    own = _sided(near, _zero_print(), _delta_domination(), _diagonal(3) if diagonal else _horizontal(3), _big_cluster(), *so_far)
    rows = _marks(bars.where("n_trades > 0"), levels, "bid").unionByName(own).unionByName(flag_auction(cells, bars, scale))
    return rows.groupBy(*BAR, "level").agg(F.bit_or("bid_flags").alias("bid_flags"), F.bit_or("ask_flags").alias("ask_flags"))

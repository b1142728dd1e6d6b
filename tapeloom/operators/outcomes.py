"""Order outcomes: when and at what price orders would have filled, and how far price moved meanwhile.

No join of orders with trades goes without a (symbol, bar) key: the bar in which an order is met is found among bars first, and trades are
looked at inside that bar only.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bar_start, floor_div, pnl, slipped_price
from ..sources.scratch import stored
from .scans import ROWS, SPAN, follow, next_point, next_point_by_blocks, scan

AT = ["symbol", "bar_start"]


class OrderPolicy(Protocol):
    """A user's reaction to a candidate in ``size_and_gate``: the size to put in, or None to let it pass."""

    def __call__(self, candidate, size: int) -> int | None: ...


def entry_fill(orders: DataFrame, trades: DataFrame, tf: int, latency: int = 100, slip_bps: int = 5, block: int = 4096) -> DataFrame:
    """Market orders (``order_id, symbol, ts_ms, is_buy``) with ``fill_ts, fill_id, fill_price`` of the first trade from ts_ms + latency on.

    The trade is in the same bar, or it is the first of the next bar with trades: in the same ``block`` of bars, or the first of the next block.
    Each is an as-of join within its bar or block; only blocks are ordered across a whole symbol.
    """
    live = orders.select("symbol", bar_start(F.col("ts_ms") + latency, tf).alias("bar_start"), (F.col("ts_ms") + latency).alias("at"), F.col("order_id").alias("ask"))
    t = trades.select("symbol", bar_start("ts_ms", tf).alias("bar_start"), F.col("ts_ms").alias("at"), F.struct(F.col("ts_ms").alias("fill_ts"), F.col("trade_id").alias("fill_id"), F.col("n_price").alias("px")).alias("t"))
    wide = floor_div("at", tf * block).alias("block")
    firsts = t.groupBy(*AT).agg(F.min("t").alias("t")).select("symbol", F.col("bar_start").alias("at"), "t").select("*", wide)
    ends = firsts.groupBy("symbol", "block").agg(F.min("t").alias("t")).select("symbol", F.col("block").alias("at"), "t")
    in_bar = next_point(live, t, AT, True).select(F.col("ask").alias("order_id"), F.col("t").alias("same"))
    in_block = next_point(live.select("symbol", F.col("bar_start").alias("at"), "ask").select("*", wide), firsts, ["symbol", "block"], False)
    asked = in_block.select("symbol", F.col("block").alias("at"), F.col("block").alias("ask")).distinct()
    beyond = next_point(asked, ends, ["symbol"], False).select("symbol", F.col("ask").alias("block"), F.col("t").alias("far"))
    later = in_block.join(beyond, ["symbol", "block"]).select(F.col("ask").alias("order_id"), F.coalesce("t", "far").alias("next"))
    out = orders.join(in_bar, "order_id", "left").join(later, "order_id", "left").withColumn("f", F.coalesce("same", "next"))
    return out.select(*orders.columns, "f.fill_ts", "f.fill_id", slipped_price(F.col("f.px"), "is_buy", slip_bps).alias("fill_price"))


def first_touch(orders: DataFrame, trades: DataFrame, bars: DataFrame, tf: int, slip_bps: int = 5, fan: int = 60, levels: int = 2) -> DataFrame:
    """Limit and stop orders with the first trade that meets them.

    ``orders``: order_id, symbol, active_ts, n_price, is_buy, is_stop. A limit buys at or below and sells at or above its price and fills there; a stop
    is triggered the other way round and fills at the slipped trade price. Bars are cut into ``fan`` slots, if that is a whole number of milliseconds. The
    trade is sought in the slot of active_ts first, and then in the earliest later slot whose high or low reaches the price. That slot is found
    in a tree: ``fan`` slots make a bar, ``fan`` bars a block, ``fan`` blocks the next larger one. An order climbs through the later siblings of its own
    slot, bar and blocks, and descends from the first that reaches, so it meets about fan rows a level and the trades of two slots; only
    the largest blocks are compared across a whole symbol.
    """
    base, fine = (tf // fan, 1) if tf % fan == 0 else (tf, 0)
    above = F.col("is_buy") == F.col("is_stop")  # met by prices at or above
    live = orders.select("order_id", "symbol", "active_ts", "n_price", above.alias("above"), floor_div("active_ts", base).alias("slot"))
    t = trades.select("symbol", floor_div("ts_ms", base).alias("slot"), F.col("ts_ms").alias("t_ms"), "trade_id", F.col("n_price").alias("px"))
    meets = "(above AND px >= n_price) OR (NOT above AND px <= n_price)"
    reaches = "(above AND high >= n_price) OR (NOT above AND low <= n_price)"
    pick = F.min(F.struct(F.col("t_ms").alias("touch_ts"), F.col("trade_id").alias("touch_id"), "px")).alias("t")
    same = live.join(t, ["symbol", "slot"]).where(f"t_ms >= active_ts AND ({meets})").groupBy("order_id").agg(pick)
    levels += fine
    widths = [base * fan**k for k in range(levels + 1)]
    traded = bars.where("n_trades > 0").select("symbol", F.col("bar_start").alias("at"), "high", "low")
    slots = stored(t.groupBy("symbol", "slot").agg(F.max("px").alias("high"), F.min("px").alias("low")).select("symbol", (F.col("slot") * base).alias("at"), "high", "low"), "touch-slots")
    nodes = [
        (traded if k >= fine else slots).groupBy("symbol", floor_div("at", w).alias("node"), floor_div("at", w * fan).alias("parent")).agg(F.max("high").alias("high"), F.min("low").alias("low")) for k, w in enumerate(widths)
    ]
    # each step is written, so that the next ones, which use it twice, do not compute it again
    step = stored(live.drop("slot").join(same, "order_id", "left"), "touch-step")
    done, pending, hit = step.where("t IS NOT NULL").select("order_id", "t"), step.where("t IS NULL").drop("t"), None
    order = pending.columns
    for k, w in enumerate(widths):
        asked = pending.withColumns({"own": floor_div("active_ts", w), "parent": floor_div("active_ts", w * fan)})
        near = asked.join(nodes[k], ["symbol", "parent"]) if k < levels else asked.drop("parent").join(nodes[k].drop("parent"), "symbol")
        found = near.where(f"node > own AND ({reaches})").groupBy("order_id").agg(F.min("node").alias("node"))
        step = stored(pending.join(found, "order_id", "left"), "touch-step")
        reached, pending = step.where("node IS NOT NULL"), step.where("node IS NULL").drop("node")
        for j in range(k - 1, -1, -1):
            inside = reached.withColumnRenamed("node", "parent").join(nodes[j], ["symbol", "parent"]).where(reaches)
            reached = inside.groupBy(*order).agg(F.min("node").alias("node"))
        reached = reached.select(*order, "node")
        hit = reached if hit is None else hit.union(reached)
        if pending.isEmpty():
            break
    later = hit.withColumnRenamed("node", "slot").join(t, ["symbol", "slot"]).where(meets).groupBy("order_id").agg(pick)
    out = orders.join(done.union(later), "order_id", "left")
    price = F.when(F.col("t").isNotNull(), F.when(F.col("is_stop"), slipped_price(F.col("t.px"), "is_buy", slip_bps)).otherwise(F.col("n_price")))
    return out.select(*orders.columns, "t.touch_ts", "t.touch_id", price.alias("touch_price"))


def bracket_outcome(entries: DataFrame, trades: DataFrame, bars: DataFrame, tf: int, latency: int = 100, slip_bps: int = 5) -> DataFrame:
    """Take profit (limit) against stop loss (trigger) from each entry fill, whichever is met first; both null while open.

    ``entries``: order_id, symbol, is_long, fill_ts, fill_price, tp_bps, sl_bps. A tie goes to the earlier trade and then to the take profit.
    """
    moved = lambda bps, up: F.when(F.col("is_long") == F.lit(up), F.col("fill_price") + floor_div(F.col("fill_price") * F.col(bps), 10_000)).otherwise(F.col("fill_price") - floor_div(F.col("fill_price") * F.col(bps), 10_000))
    filled = entries.where("fill_ts IS NOT NULL")
    legs = None
    for name, bps, up, stop in (("tp", "tp_bps", True, False), ("sl", "sl_bps", False, True)):
        leg = filled.select(F.col("order_id").alias("parent"), F.concat_ws(":", F.col("order_id").cast("string"), F.lit(name)).alias("order_id"), F.lit(name).alias("leg"), "symbol", (F.col("fill_ts") + latency).alias("active_ts"), moved(bps, up).alias("n_price"), (~F.col("is_long")).alias("is_buy"), F.lit(stop).alias("is_stop"))
        legs = leg if legs is None else legs.unionByName(leg)
    touched = first_touch(legs, trades, bars, tf, slip_bps).where("touch_ts IS NOT NULL")
    first = touched.groupBy("parent").agg(F.min(F.struct("touch_ts", "touch_id", F.when(F.col("leg") == "tp", 0).otherwise(1).alias("r"), "leg", "touch_price")).alias("x"))
    return entries.join(first.withColumnRenamed("parent", "order_id"), "order_id", "left").select(*entries.columns, F.col("x.leg").alias("exit_leg"), F.col("x.touch_ts").alias("exit_ts"), F.col("x.touch_id").alias("exit_id"), F.col("x.touch_price").alias("exit_price"))


def one_position_per_side(candidates: DataFrame, width: int = SPAN) -> DataFrame:
    """Candidates (``run_id, symbol, is_long, ts_ms, order_id, end_ts``) that open while their side is empty.

    Signals up to the end of the open position are ignored; a null end never closes, and an end before its own signal counts as at it. Each candidate points to the first one after its
    end, an as-of join, and the chain from a side's first candidate is followed by blocks of ``width`` milliseconds, so that no side is walked by one task.
    """
    keys = ["run_id", "symbol", "is_long"]
    own = stored(candidates, "candidates")
    at = F.struct("ts_ms", "order_id")
    asks = own.where("end_ts IS NOT NULL").select(*keys, F.greatest("end_ts", "ts_ms").alias("at"), at.alias("ask"))
    to = next_point_by_blocks(asks, own.select(*keys, F.col("ts_ms").alias("at"), at.alias("t")), keys, width, False)
    pointers = to.select(*keys, F.col("ask").alias("at"), F.col("ask.ts_ms").alias("place"), F.col("t").alias("next"), F.col("t.ts_ms").alias("next_place"))
    last = own.where("end_ts IS NULL").select(*keys, at.alias("at"), F.col("ts_ms").alias("place"), F.lit(None).cast(pointers.schema["next"].dataType).alias("next"), F.lit(None).cast("long").alias("next_place"))
    taken = follow(pointers.union(last), keys, width).select(*keys, "at.ts_ms", "at.order_id")
    return own.join(taken, [*keys, "ts_ms", "order_id"]).select(*candidates.columns)


def size_and_gate(candidates: DataFrame, policy: OrderPolicy | None = None, start: int = 100 * 10**8, leverage: int = 20, entry_bps: int = 100, max_loss_bps: int = 1000, max_lock_bps: int = 1000, min_size: int = 5 * 10**8, price_mult: int = 100, qty_mult: int = 1000, taker_bps: int = 5, maker_bps: int = 2, money: int = 10**8) -> DataFrame:
    """Walk each run's signals in time order: stop at the loss limit or when the size is too small, skip while too much is locked, else size
    the position, take fees and the result of its exit.

    ``candidates``: run_id, order_id, symbol, is_long, fill_ts, fill_price, exit_ts, exit_price, exit_is_maker. ``policy(row, size)`` may change or refuse (None) the size.
    """
    schema = "run_id long, order_id string, symbol string, is_long boolean, fill_ts long, fill_price long, exit_ts long, exit_price long, n_qty long, fee long, pnl long, balance long"

    def walk(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["fill_ts", "order_id"])
        balance, open_, rows = start, [], []
        for r in pdf.itertuples(index=False):
            for e in sorted(x for x in open_ if x[0] <= r.fill_ts):
                balance += e[1]
                open_.remove(e)
            locked = sum(x[2] for x in open_)
            if balance <= start - start * max_loss_bps // 10_000:
                break
            if locked >= balance * max_lock_bps // 10_000:
                continue
            size = (balance - locked) * entry_bps // 10_000 * leverage
            if size <= min_size:
                break
            size = policy(r, size) if policy else size
            if size is None or not r.fill_price:
                continue
            qty = round(size / money * price_mult * qty_mult / r.fill_price)
            notional = r.fill_price / price_mult * qty / qty_mult
            fee = round(notional * money * taker_bps / 10_000)
            balance -= fee
            gain = None
            if r.exit_ts == r.exit_ts and r.exit_ts is not None:
                out = r.exit_price / price_mult * qty / qty_mult
                exit_fee = round(out * money * (maker_bps if r.exit_is_maker else taker_bps) / 10_000)
                gain = round((r.exit_price - r.fill_price) * (1 if r.is_long else -1) / price_mult * qty / qty_mult * money)
                open_.append((r.exit_ts, gain - exit_fee, round(notional / leverage * money)))
            else:
                open_.append((float("inf"), 0, round(notional / leverage * money)))
            rows.append((r.run_id, str(r.order_id), r.symbol, r.is_long, r.fill_ts, r.fill_price, r.exit_ts, r.exit_price, qty, fee, gain, balance))
        names = [x.split()[0] for x in schema.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: "Int64" for c in ("exit_ts", "exit_price", "pnl")})

    return candidates.groupBy("run_id").applyInPandas(walk, schema)


def cancel_effective(touched: DataFrame, cancels: DataFrame, latency: int = 100) -> DataFrame:
    """Touched orders without those whose cancel (``order_id, cancel_ts``) took effect, at cancel_ts + latency, at or before the touch."""
    by = cancels.groupBy("order_id").agg((F.min("cancel_ts") + latency).alias("_gone"))
    joined = touched.join(by, "order_id", "left")
    return joined.where("_gone IS NULL OR (touch_ts IS NOT NULL AND touch_ts < _gone)").drop("_gone")


def mae_mfe(positions: DataFrame, trades: DataFrame, bars: DataFrame, tf: int, price_mult: int = 100, qty_mult: int = 1000, fan: int = 64) -> DataFrame:
    """Positions (``order_id, symbol, is_long, n_qty, fill_ts, fill_price, exit_ts``) with the least and greatest unrealised result while open,
    never above and below 0. Both ends are included: the two edge bars give their trades, bars in between their high and low, and whole blocks
    of ``fan`` bars theirs, so a position meets n / fan + 2 fan rows and not n.
    """
    held = positions.where("fill_ts IS NOT NULL AND exit_ts IS NOT NULL").select("order_id", "symbol", "fill_ts", "exit_ts", bar_start("fill_ts", tf).alias("b0"), bar_start("exit_ts", tf).alias("b1"))
    block = tf * fan
    held = held.withColumns({"f0": -floor_div(-(F.col("b0") + tf), block) * block, "f1": floor_div("b1", block) * block})
    whole = F.col("f0") < F.col("f1")
    steps = lambda a, b, w: F.when(b > a, F.sequence(a, b - w, F.lit(w).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    between = F.when(whole, F.concat(steps(F.col("b0") + tf, F.col("f0"), tf), steps(F.col("f1"), F.col("b1"), tf))).otherwise(steps(F.col("b0") + tf, F.col("b1"), tf))
    traded = bars.where("n_trades > 0")
    inner = held.select("order_id", "symbol", F.explode(between).alias("bar_start")).join(traded.select(*AT, "high", "low"), AT).select("order_id", "high", "low")
    blocks = traded.groupBy("symbol", (floor_div("bar_start", block) * block).alias("block")).agg(F.max("high").alias("high"), F.min("low").alias("low"))
    large = held.where(whole).select("order_id", "symbol", F.explode(steps(F.col("f0"), F.col("f1"), block)).alias("block")).join(blocks, ["symbol", "block"]).select("order_id", "high", "low")
    t = trades.select("symbol", bar_start("ts_ms", tf).alias("bar_start"), F.col("ts_ms").alias("t_ms"), "n_price")
    edges = held.select("order_id", "symbol", "fill_ts", "exit_ts", F.explode(F.array_distinct(F.array("b0", "b1"))).alias("bar_start"))
    outer = edges.join(t, AT).where("t_ms BETWEEN fill_ts AND exit_ts").select("order_id", F.col("n_price").alias("high"), F.col("n_price").alias("low"))
    seen = inner.union(large).union(outer).groupBy("order_id").agg(F.max("high").alias("_hi"), F.min("low").alias("_lo"))
    joined = positions.join(seen, "order_id", "left")
    result = lambda worst: pnl("fill_price", F.when(F.col("is_long") == F.lit(worst), F.col("_lo")).otherwise(F.col("_hi")), "n_qty", "is_long", price_mult, qty_mult)
    return joined.select(*positions.columns, F.least(F.lit(0).cast("long"), result(True)).alias("n_mae"), F.greatest(F.lit(0).cast("long"), result(False)).alias("n_mfe"))


def locked_margin(events: DataFrame) -> DataFrame:
    """Margin locked after each event: ``run_id, ts_ms, seq, amount`` with positive amounts on opening and negative on closing or cancelling."""
    return scan(events, ["run_id"], ["ts_ms", "seq"], SPAN, {"locked": ("sum", "amount")})


def equity_ohlc(states: DataFrame, trades: DataFrame, bars: DataFrame, tf: int, price_mult: int = 100, qty_mult: int = 1000) -> DataFrame:
    """Equity bars of each run: balance plus the unrealised result, sampled at every trade while a state holds.

    ``states``: run_id, symbol, since, until (exclusive, null for open), balance, n_qty, entry, is_long. Equity is linear in price, so a bar that lies inside one
    state takes its figures from the price bar; only the bars in which a state begins or ends are joined to their trades.
    Bars without samples carry the close of the one before.
    """
    last = bars.groupBy("symbol").agg(F.max("last_trade_time").alias("_end"))
    spans = states.join(last, "symbol").withColumn("_to", F.coalesce("until", F.col("_end") + 1)).where("_to > since")
    spans = spans.withColumns({"b0": bar_start("since", tf), "b1": bar_start(F.col("_to") - 1, tf)})
    value = lambda px: F.col("balance") + F.when(F.col("n_qty") > 0, pnl("entry", px, "n_qty", "is_long", price_mult, qty_mult)).otherwise(0)
    t = trades.select("symbol", bar_start("ts_ms", tf).alias("bar_start"), F.col("ts_ms").alias("t_ms"), "trade_id", "n_price")
    edges = spans.withColumn("bar_start", F.explode(F.array_distinct(F.array("b0", "b1")))).join(t, AT).where("t_ms >= since AND t_ms < _to")
    at = F.struct("t_ms", "trade_id")
    sampled = edges.withColumn("v", value("n_price")).groupBy("run_id", "bar_start").agg(F.min_by("v", at).alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", at).alias("close"))
    inside = spans.where(F.col("b1") - F.col("b0") > tf).withColumn("bar_start", F.explode(F.sequence(F.col("b0") + tf, F.col("b1") - tf, F.lit(tf).cast("long"))))
    priced = inside.join(bars.where("n_trades > 0").select(*AT, "open", "high", "low", "close"), AT)
    quiet = priced.select("run_id", "bar_start", value("open").alias("open"), F.greatest(value("high"), value("low")).alias("high"), F.least(value("high"), value("low")).alias("low"), value("close").alias("close"))
    found = sampled.union(quiet)
    ends = found.groupBy("run_id").agg(F.min("bar_start").alias("a"), F.max("bar_start").alias("b"))
    frame = ends.select("run_id", F.explode(F.sequence("a", "b", F.lit(tf).cast("long"))).alias("bar_start"))
    filled = scan(frame.join(found, ["run_id", "bar_start"], "left"), ["run_id"], ["bar_start"], tf * ROWS, {"_c": ("fill", "close")})
    return filled.select("run_id", "bar_start", *[F.coalesce(c, "_c").alias(c) for c in ("open", "high", "low", "close")])


def expand_runs(lists: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each run of a row of parameter lists: run i takes element i, shorter lists repeat their last."""
    longest = F.greatest(*[F.size(c) for c in columns]) if len(columns) > 1 else F.size(columns[0])
    runs = lists.withColumn("run_no", F.explode(F.sequence(F.lit(0), longest - 1)))
    picked = [F.get(F.col(c), F.least(F.col("run_no"), F.size(c) - 1)).alias(c) for c in columns]
    return runs.select(*[c for c in lists.columns if c not in columns], "run_no", *picked)


def date_grid(df: DataFrame, start: Column | str, step_days: Column | int, count: Column | int, include_start: bool = True) -> DataFrame:
    """ISO dates of a sweep: ``count`` dates every ``step_days`` from ``start``, with or without it."""
    start = F.col(start) if isinstance(start, str) else start
    count, step = (x if isinstance(x, Column) else F.lit(x) for x in (count, step_days))
    first = 0 if include_start else 1
    days = F.transform(F.sequence(F.lit(first), count - 1 + first), lambda i: F.date_format(F.date_add(start, (i * step).cast("int")), "yyyy-MM-dd"))
    return df.select("*", F.posexplode(days).alias("date_no", "date"))



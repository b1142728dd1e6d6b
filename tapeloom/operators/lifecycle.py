"""Life cycles of orders: a policy answers signals, fills and cancels with new orders, for all runs at once.

A round resolves the orders that are new: market orders fill at the first trade, limits and stops at the first trade that meets them, of orders in one group (one cancels the other) the
first one met fills, and an order with an end is cancelled there. What happened goes to the policy's hooks, whose orders make the next round. A chain of orders takes as many rounds as it is
long, however many chains there are, and no run's trades are walked by one task.
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import floor_div
from ..sources.scratch import stored
from .outcomes import entry_fill, first_touch

#: An order: of a chain and its step, sent at ts_ms; kind is market, limit or stop; the orders of one ``oco`` cancel each other; ``until`` ends it.
ORDER = {
    "chain": "string", "step": "int", "order_id": "string", "symbol": "string", "is_long": "boolean", "is_buy": "boolean", "kind": "string", "n_price": "long", "ts_ms": "long",
    "until": "long", "oco": "string", "tp_bps": "long", "sl_bps": "long",
}


class LifeCycle(Protocol):
    """A user's reaction to what happens. Hooks take the events and return orders (columns of ORDER, missing ones null), or None."""

    def on_signal(self, signals: DataFrame) -> DataFrame: ...

    def on_fill(self, fills: DataFrame) -> DataFrame | None: ...

    def on_cancel(self, cancels: DataFrame) -> DataFrame | None: ...


def orders_of(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of ORDER, null where they lack one."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in ORDER.items()])


class Bracket:
    """A market entry for each signal, a take profit and a stop for each entry, and up to ``reenter`` new entries of a chain, each when its stop was met."""

    def __init__(self, reenter: int = 0):
        self.reenter = reenter

    def on_signal(self, signals: DataFrame) -> DataFrame:
        """``signals``: order_id, symbol, ts_ms, is_long, tp_bps, sl_bps."""
        chain = F.col("order_id").cast("string")
        return signals.withColumns({"chain": chain, "step": F.lit(0), "order_id": F.concat(chain, F.lit("/0")), "is_buy": F.col("is_long"), "kind": F.lit("market"), "n_price": F.lit(None)})

    def on_fill(self, fills: DataFrame) -> DataFrame:
        entries, stops = fills.where("kind = 'market'"), fills.where(f"kind = 'stop' AND step < {self.reenter}")
        move = lambda bps: floor_div(F.col("fill_price") * F.col(bps), 10_000)
        away = lambda bps, up: F.when(F.col("is_long") == F.lit(up), F.col("fill_price") + move(bps)).otherwise(F.col("fill_price") - move(bps))
        legs = [
            entries.withColumns({"oco": F.col("order_id"), "order_id": F.concat("order_id", F.lit(f":{name}")), "kind": F.lit(kind), "n_price": away(bps, up), "ts_ms": F.col("event_ts"), "is_buy": ~F.col("is_long"), "until": F.lit(None)})
            for name, kind, bps, up in (("tp", "limit", "tp_bps", True), ("sl", "stop", "sl_bps", False))
        ]
        again = stops.withColumns({
            "step": F.col("step") + 1, "order_id": F.concat("chain", F.lit("/"), (F.col("step") + 1).cast("string")), "kind": F.lit("market"), "ts_ms": F.col("event_ts"), "is_buy": F.col("is_long"),
            "n_price": F.lit(None), "oco": F.lit(None), "until": F.lit(None),
        })
        return reduce(DataFrame.union, [orders_of(x) for x in (*legs, again)])

    def on_cancel(self, cancels: DataFrame) -> None:
        return None


def _resolve(orders: DataFrame, trades: DataFrame, bars: DataFrame, tf: int, latency: int, slip_bps: int) -> DataFrame:
    """``orders`` with ``status`` (filled, cancelled, open), ``event_ts, event_id, fill_price``."""
    market = entry_fill(orders.where("kind = 'market'").select("order_id", "symbol", "ts_ms", "is_buy"), trades, tf, latency, slip_bps).select("order_id", F.col("fill_ts").alias("met_ts"), F.col("fill_id").alias("met_id"), F.col("fill_price").alias("met_price"))
    waiting = orders.where("kind <> 'market'").select("order_id", "symbol", (F.col("ts_ms") + latency).alias("active_ts"), "n_price", "is_buy", (F.col("kind") == "stop").alias("is_stop"))
    touched = first_touch(waiting, trades, bars, tf, slip_bps).select("order_id", F.col("touch_ts").alias("met_ts"), F.col("touch_id").alias("met_id"), F.col("touch_price").alias("met_price"))
    gone = F.col("until") + latency
    met = orders.join(market.union(touched), "order_id", "left").withColumn("gone", gone).withColumn("met", F.col("met_ts").isNotNull() & (F.col("gone").isNull() | (F.col("met_ts") < F.col("gone"))))
    met = met.withColumn("group", F.coalesce("oco", "order_id"))
    at = F.struct(F.col("met_ts").alias("ts"), F.col("met_id").alias("id"), F.when(F.col("kind") == "stop", 1).otherwise(0).alias("r"), F.col("order_id").alias("by"))
    won = met.where("met").groupBy("group").agg(F.min(at).alias("won"))
    both = met.join(won, "group", "left")
    mine, other = F.col("won.by") == F.col("order_id"), F.col("won").isNotNull() & (F.col("gone").isNull() | (F.col("won.ts") <= F.col("gone")))
    status = F.when(mine, "filled").when(other | F.col("gone").isNotNull(), "cancelled").otherwise("open")
    when = F.when(mine | other, F.col("won.ts")).otherwise(F.col("gone"))
    mine_ = lambda c: F.when(mine, F.col(c))
    return both.select(*ORDER, status.alias("status"), when.alias("event_ts"), mine_("met_id").alias("event_id"), mine_("met_price").alias("fill_price"))


def run_orders(signals: DataFrame, trades: DataFrame, bars: DataFrame, tf: int, policy: LifeCycle | None = None, latency: int = 100, slip_bps: int = 5, most_rounds: int = 100) -> DataFrame:
    """Every order that ``policy`` (default: ``Bracket``) makes of the signals, with what became of it.

    A chain of more than ``most_rounds`` orders is an error, as a policy that always answers would never end.
    """
    policy = policy or Bracket()
    new, done = stored(orders_of(policy.on_signal(signals)), "orders"), None
    for _ in range(most_rounds):
        if new.isEmpty():
            break
        resolved = stored(_resolve(new, trades, bars, tf, latency, slip_bps), "orders-resolved")
        done = resolved if done is None else done.union(resolved)
        answers = [policy.on_fill(resolved.where("status = 'filled'")), policy.on_cancel(resolved.where("status = 'cancelled'"))]
        answers = [orders_of(x) for x in answers if x is not None]
        if not answers:
            break
        new = stored(reduce(DataFrame.union, answers), "orders")
    else:
        raise RuntimeError(f"a chain of orders did not end in {most_rounds} rounds")
    return done if done is not None else _resolve(new, trades, bars, tf, latency, slip_bps)


def round_trips(orders: DataFrame) -> DataFrame:
    """``chain, step, symbol, is_long, fill_ts, fill_price, exit_leg, exit_ts, exit_price``: each filled market entry with the leg of its group that ended it."""
    entry = orders.where("kind = 'market' AND status = 'filled'").select("chain", "step", "symbol", "is_long", F.col("order_id").alias("oco"), F.col("event_ts").alias("fill_ts"), "fill_price")
    leg: Column = F.when(F.col("kind") == "limit", "tp").otherwise("sl")
    ends = orders.where("kind <> 'market' AND status = 'filled'").select("oco", leg.alias("exit_leg"), F.col("event_ts").alias("exit_ts"), F.col("fill_price").alias("exit_price"))
    return entry.join(ends, "oco", "left").drop("oco")

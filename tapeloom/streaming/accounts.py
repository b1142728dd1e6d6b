"""Accounts of a stream of order events: the state of each position side, with orders that lapse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import has_flag, is_open_order

_EVENT = "ts_ms long, seq long, state string, order_param long, order_id long, n_price long, n_qty long"
_NAMES = [c.split()[0] for c in _EVENT.split(", ")]
#: What a pending order leaves behind when it lapses.
_LAPSED = {"PENDING": "EMPTY", "CLOSE": "OPEN"}
#: Events that a task holds at once while it looks for the latest of each side.
HELD_EVENTS = 1 << 17


def position_state(order_param: str = "order_param") -> Column:
    """OPEN, EMPTY, PENDING (to open) or CLOSE (pending) after an order event."""
    opens, filled, cancelled = is_open_order(order_param), has_flag(order_param, "FILLED", "order"), has_flag(order_param, "CANCELED", "order")
    return F.when(filled, F.when(opens, "OPEN").otherwise("EMPTY")).when(cancelled, F.when(opens, "EMPTY").otherwise("OPEN")).otherwise(F.when(opens, "PENDING").otherwise("CLOSE"))


def position_side(order_param: str = "order_param") -> Column:
    return F.when(has_flag(order_param, "LONG", "order"), "LONG").when(has_flag(order_param, "SHORT", "order"), "SHORT")


class _Position:
    """The latest event of one side of one account's symbol by (time, seq), whatever order events come in."""

    expire_ms = 0

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"{_EVENT}, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        kept = self.last.get() if self.last.exists() else None
        best = max((tuple(r) for pdf in rows for r in pdf[_NAMES].itertuples(index=False)), key=lambda r: (r[0], r[1]))
        out = []
        if kept is None or (int(best[0]), int(best[1])) > (int(kept[0]), int(kept[1])):
            kept = (int(best[0]), int(best[1]), best[2], *map(int, best[3:]), int(kept[-1]) + 1 if kept else 1)
            self.last.update(kept)
            out.append((*key, *kept, False))
            if kept[2] in _LAPSED:
                self.handle.registerTimer(kept[0] + self.expire_ms)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.last.exists():
            kept = self.last.get()
            if kept[2] in _LAPSED and int(kept[0]) + self.expire_ms <= expiredTimerInfo.getExpiryTimeInMs():
                kept = (int(kept[0]), int(kept[1]), _LAPSED[kept[2]], *map(int, kept[3:-1]), int(kept[-1]) + 1)
                self.last.update(kept)
                out.append((*key, *kept, True))
        yield self._rows(out)

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["account", "symbol", "side", *_NAMES, "version", "lapsed"])

    def close(self) -> None:
        pass


def _latest_of_sides(events: pa.Table) -> pa.Table:
    """The latest event by (time, seq) of each side of an account's symbol."""
    side = np.zeros(len(events), np.int64)
    for name in ("account", "symbol", "side"):
        codes = pc.dictionary_encode(events[name].combine_chunks(), null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        side = np.unique(side * (len(codes.dictionary) + 1) + codes.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.lexsort((events["seq"].to_numpy(), events["ts_ms"].to_numpy(), side))
    return events.take(pa.array(order[np.append(np.diff(side[order]) != 0, True)])) if len(order) else events


def latest_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the events of a task, the latest of each side, and a heartbeat (no account) with the greatest ``ts``; sides that no longer fit go on early."""
    held, size, top, like = [], 0, None, None
    for batch in batches:
        rows = pa.Table.from_batches([batch]).filter(pc.field("ts").is_valid())
        if not len(rows):
            continue
        like, newest = rows.schema, pc.max(rows["ts"])
        top = newest if top is None or newest.value > top.value else top
        held.append(_latest_of_sides(rows.filter(pc.field("account").is_valid() & pc.field("side").is_valid())))
        size += len(held[-1])
        if size > HELD_EVENTS:
            held = [_latest_of_sides(pa.concat_tables(held))]
            size = len(held[0])
            if size > HELD_EVENTS // 2:
                yield from held[0].combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from _latest_of_sides(pa.concat_tables(held)).combine_chunks().to_batches()
    if like is not None:
        yield pa.RecordBatch.from_arrays([pa.array([top.as_py() if f.name == "ts" else None], f.type) for f in like], schema=like)


def stream_positions(order_events: DataFrame, expire_ms: int, delay: str = "10 minutes") -> DataFrame:
    """Changes of position states: ``account, symbol, side, ts_ms, seq, state, order_param, order_id, n_price, n_qty, version, lapsed``, of which the greatest version of a side holds.

    ``order_events`` are decoded events of a stream with ``account``, ``seq`` (which orders events of one time) and ``ts`` (``ts_ms`` as a TIMESTAMP). Of a trigger, tasks send
    only the latest event of each side that they read to its state. An event that is older than the one known changes
    nothing, so the end does not depend on the order of arrival. An order that is neither filled nor cancelled within ``expire_ms`` lapses once the watermark passes: a side
    that waited to open is EMPTY again, one that waited to close stays OPEN. Rows without an account are heartbeats (needs the RocksDB state store).
    """
    from pyspark.sql.streaming import StatefulProcessor

    asked = order_events.select(F.col("account").cast("string").alias("account"), "symbol", position_side().alias("side"), "ts_ms", F.col("seq").cast("long").alias("seq"), position_state().alias("state"), *[F.col(c).cast("long").alias(c) for c in _NAMES[3:]], "ts")
    latest = asked.mapInArrow(latest_events, f"account string, symbol string, side string, {_EVENT}, ts timestamp")
    # one condition that reads ts: any other would be moved below the watermark, which then misses the heartbeats
    asked = latest.withWatermark("ts", delay).where(F.when(F.col("account").isNotNull(), F.col("ts")).isNotNull())
    processor = type("PositionProcessor", (_Position, StatefulProcessor), {"expire_ms": expire_ms})()
    schema = f"account string, symbol string, side string, {_EVENT}, version long, lapsed boolean"
    return asked.groupBy("account", "symbol", "side").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def positions_now(changes: DataFrame) -> DataFrame:
    """The state that holds for each side, of the changes so far."""
    rest = [c for c in changes.columns if c not in ("account", "symbol", "side")]
    return changes.groupBy("account", "symbol", "side").agg(F.max_by(F.struct(*rest), "version").alias("x")).select("account", "symbol", "side", "x.*")



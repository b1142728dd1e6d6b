"""Streams of trades: decoding, deduplication, id gaps, bars, indicators and signals.

A stream of trades has ``symbol, trade_id, ts`` (TIMESTAMP, for the watermark), ``ts_ms, n_price, n_qty, is_sell``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import floor_div, price_level, signed_qty
from ..operators.indicators import grow_area
from ..sources.decoders import decode_agg_trades, scale_trades
from .accounts import position_side, position_state

#: An id jump of at least this is fatal: 60,000 rounded up to a power of two.
GAP_LIMIT = 65_536
#: Ids of a block within which gaps are sought; ids whose gaps a stream's state keeps together; rows that a task makes runs of at once.
ID_BLOCK, GAP_BLOCK, HELD_IDS = 1_000_000, 1 << 16, 1 << 20


def stream_trades(messages: DataFrame, kind: str, price_mult: int, qty_mult: int) -> DataFrame:
    """Decoded and scaled trades of a (streaming or static) DataFrame with ``symbol`` and ``message``."""
    t = scale_trades(decode_agg_trades(messages, kind), price_mult, qty_mult)
    return t.select("symbol", F.col("agg_id").alias("trade_id"), F.timestamp_millis("ts_ms").alias("ts"), "ts_ms", "n_price", "n_qty", "is_sell")


def read_trade_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedupe_trades(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each (symbol, trade_id) once; state is dropped behind the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "trade_id"])


def merge_backfill(stream: DataFrame, backfill: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Live and backfilled trades together, each once. Event-time windows make their order irrelevant."""
    return dedupe_trades(stream.unionByName(backfill), delay)


def trade_gaps(trades: DataFrame) -> DataFrame:
    """``symbol, after_id, before_id, missing``: id ranges missing between consecutive ids, whatever the times.

    Windows run within blocks of ``ID_BLOCK`` ids, and a block's last id meets the next block's first, so that no symbol's history is in one task.
    """
    ids = trades.select("symbol", "trade_id", floor_div("trade_id", ID_BLOCK).alias("block")).distinct()
    within = ids.withColumn("next_id", F.lead("trade_id").over(Window.partitionBy("symbol", "block").orderBy("trade_id"))).where("next_id IS NOT NULL").select("symbol", "trade_id", "next_id")
    ends = ids.groupBy("symbol", "block").agg(F.min("trade_id").alias("first"), F.max("trade_id").alias("last"))
    across = ends.withColumn("next_id", F.lead("first").over(Window.partitionBy("symbol").orderBy("block"))).where("next_id IS NOT NULL").select("symbol", F.col("last").alias("trade_id"), "next_id")
    return within.union(across).where("next_id > trade_id + 1").select("symbol", F.col("trade_id").alias("after_id"), F.col("next_id").alias("before_id"), (F.col("next_id") - F.col("trade_id") - 1).alias("missing"))


def gap_requests(gaps: DataFrame, size: int = 1000) -> DataFrame:
    """Id ranges of at most ``size`` ids that cover each gap; neighbours share an edge id."""
    starts = F.sequence(F.col("after_id"), F.col("before_id") - 1, F.lit(size - 1).cast("long"))
    return gaps.select("symbol", "after_id", F.explode(starts).alias("from_id"), "before_id").select("symbol", "after_id", "from_id", F.least(F.col("from_id") + (size - 1), "before_id").alias("to_id"))


def gap_limit_alert(gaps: DataFrame, limit: int = GAP_LIMIT) -> DataFrame:
    return gaps.where(F.col("before_id") - F.col("after_id") >= limit)


class _GapSet:
    """The hull of the ids seen of each symbol, and the gaps in it, each with the time it was noticed and whether it has been reported.

    The gaps that start in ``GAP_BLOCK`` ids are one packed value, so that a trigger reads and writes the blocks it meets, whatever else is known.
    """

    delay_ms = 60_000

    def init(self, handle) -> None:
        self.handle = handle
        self.hull = handle.getValueState("hull", "first long, last long")
        self.blocks = handle.getMapState("blocks", "block long", "gaps binary")
        self.waiting = handle.getMapState("waiting", "block long", "oldest long")  # of the gaps not reported yet

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows))
        now = int(pdf["arrived"].max())
        first, last = merged_runs(pdf["first_id"].to_numpy(np.int64), pdf["last_id"].to_numpy(np.int64))
        low, high = int(first[0]), int(last[-1])
        if self.hull.exists():
            at, to = map(int, self.hull.get())
            beyond = [(a, b, now, 0) for a, b in ((low, at), (to, high)) if a < b]
            low, high = min(low, at), max(high, to)
        else:
            beyond, to = [(low, high, now, 0)], low
        self.hull.update((low, high))
        kept = np.concatenate([*map(self._read, self._met(first, last, to)), np.array(beyond, np.int64).reshape(-1, 4)])
        left, source, cut = without_runs(kept, first, last)
        known = len(kept) - len(beyond)
        fresh = cut[source] | (source >= known)
        changed = np.unique(np.concatenate((kept[:known][cut[:known], 0], left[fresh, 0])) // GAP_BLOCK)
        ordered = left[np.argsort(left[:, 0])]
        starts, ends = (np.searchsorted(ordered[:, 0], (changed + i) * GAP_BLOCK) for i in (0, 1))
        for block, a, b in zip(changed.tolist(), starts, ends, strict=True):
            self._write(block, ordered[a:b])
        for since in np.unique(left[fresh & (left[:, 3] == 0), 2]).tolist():
            self.handle.registerTimer(since + self.delay_ms)
        yield self._rows(key, kept[cut & (kept[:, 3] == 1)], left[fresh & (left[:, 3] == 1)], now)

    def _met(self, first: np.ndarray, last: np.ndarray, end: int) -> list[int]:
        """The known blocks with gaps that may hold ids of the runs, and the one where the hull ended."""
        known = np.array(sorted(int(k[0]) for k in self.blocks.keys()), np.int64)
        until = (np.append(known[1:], np.iinfo(np.int64).max // GAP_BLOCK - 1) + 1) * GAP_BLOCK  # the gaps of a block end before those of the next
        at = np.searchsorted(last, known * GAP_BLOCK)
        met = (at < len(first)) & (first[np.minimum(at, len(first) - 1)] < until)
        return known[met | (known == end // GAP_BLOCK)].tolist()

    def _read(self, block: int) -> np.ndarray:
        return np.frombuffer(bytes(self.blocks.getValue((block,))[0]), np.int64).reshape(-1, 4)

    def _write(self, block: int, gaps: np.ndarray) -> None:
        if len(gaps):
            self.blocks.updateValue((block,), (gaps.tobytes(),))
        else:
            self.blocks.removeKey((block,))
        untold = gaps[gaps[:, 3] == 0, 2]
        if len(untold):
            self.waiting.updateValue((block,), (int(untold.min()),))
        else:
            self.waiting.removeKey((block,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        told = [np.empty((0, 4), np.int64)]
        for block in sorted(int(k[0]) for k, x in self.waiting.iterator() if int(x[0]) + self.delay_ms <= at):
            gaps = self._read(block).copy()
            due = (gaps[:, 3] == 0) & (gaps[:, 2] + self.delay_ms <= at)
            gaps[due, 3] = 1
            self._write(block, gaps)
            told.append(gaps[due])
        yield self._rows(key, told[0], np.concatenate(told), at)

    def _rows(self, key, gone: np.ndarray, told: np.ndarray, at: int) -> pd.DataFrame:
        both = np.concatenate((gone, told))
        out = pd.DataFrame({"symbol": key[0], "after_id": both[:, 0], "before_id": both[:, 1], "missing": both[:, 1] - both[:, 0] - 1, "change": np.repeat([-1, 1], [len(gone), len(told)]), "at_ms": at}, columns=["symbol", "after_id", "before_id", "missing", "change", "at_ms"])
        return out.sort_values(["after_id", "before_id", "change"])

    def close(self) -> None:
        pass


def merged_runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids, overlapping and neighbouring ones joined, in order."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    starts = np.append(True, first[1:] > reach[:-1] + 1)
    return first[starts], reach[np.append(starts[1:], True)]


def without_runs(gaps: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What merged runs leave of ``gaps`` (rows of after_id, before_id, and others), the gap that each piece is of, and whether a gap lost ids."""
    after, before = gaps[:, 0], gaps[:, 1]
    start = np.searchsorted(last, after + 1)
    inside = np.maximum(np.searchsorted(first, before - 1, "right") - start, 0)
    source = np.repeat(np.arange(len(gaps)), inside + 1)
    nth = np.arange(len(source)) - np.repeat(np.cumsum(inside + 1) - inside - 1, inside + 1)
    run = start[source] + nth
    left = gaps[source]
    left[:, 0] = np.where(nth == 0, after[source], last[np.clip(run - 1, 0, len(last) - 1)])
    left[:, 1] = np.where(nth == inside[source], before[source], first[np.clip(run, 0, len(first) - 1)])
    real = left[:, 1] - left[:, 0] > 1
    return left[real], source[real], inside > 0


def id_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (symbol, trade_id, time) of a task as runs of ids (symbol, first, last, time), ``HELD_IDS`` rows at once, with the latest time of the symbol's; and a heartbeat with the latest of all."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= HELD_IDS:
            yield from _runs_of(pa.Table.from_batches(held))
            held, size = [], 0
    if size:
        yield from _runs_of(pa.Table.from_batches(held))


def _runs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    names, (symbol, trade_id, time) = ["symbol", "first_id", "last_id", "_at"], rows.schema.names
    rows = rows.filter(pc.field(time).is_valid())
    if not len(rows):
        return
    kind = rows.schema.field(time).type
    latest = int(rows[time].cast(pa.int64()).to_numpy().max())
    yield pa.record_batch([pa.array([None], pa.string()), *[pa.array([None], pa.int64())] * 2, pa.array([latest], pa.int64()).cast(kind)], names=names)
    rows = rows.filter(pc.field(symbol).is_valid() & pc.field(trade_id).is_valid())
    if not len(rows):
        return
    coded = rows[symbol].combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    code, ids, times = coded.indices.to_numpy(), rows[trade_id].to_numpy(), rows[time].cast(pa.int64()).to_numpy()
    newest = np.full(len(coded.dictionary), np.iinfo(np.int64).min)
    np.maximum.at(newest, code, times)
    order = np.lexsort((ids, code))
    code, ids = code[order], ids[order]
    starts = np.append(True, (np.diff(code) != 0) | (np.diff(ids) > 1))
    ends = np.append(starts[1:], True)
    yield pa.record_batch([coded.dictionary.take(pa.array(code[starts])), pa.array(ids[starts]), pa.array(ids[ends]), pa.array(newest[code[starts]]).cast(kind)], names=names)


def merged_ranges(known: dict[int, int], ids: np.ndarray) -> dict[int, int]:
    """``known`` ranges (first to last) with the rising ``ids``, neighbours joined, in order."""
    cut = np.flatnonzero(np.diff(ids) > 1) + 1
    firsts, lasts = ids[np.concatenate(([0], cut))].tolist() if len(ids) else [], ids[np.concatenate((cut - 1, [-1]))].tolist() if len(ids) else []
    out: dict[int, int] = {}
    at = None
    for first, last in sorted([*known.items(), *zip(firsts, lasts, strict=True)]):
        if at is not None and first <= out[at] + 1:
            out[at] = max(out[at], last)
        else:
            at, out[first] = first, last
    return out


def stream_gaps(stream: DataFrame, delay_ms: int = 60_000, arrived: str = "ts", lateness: str = "0 seconds") -> DataFrame:
    """Changes of the set of missing id ranges: ``symbol, after_id, before_id, missing, change, at_ms``; change 1 reports a gap, -1 takes one back.

    A gap is reported once it is ``delay_ms`` old by the time of arrival (column ``arrived``, whose watermark drives the timers; a row without a symbol is a heartbeat).
    Ids that arrive later, by a backfill say, close it, or leave smaller gaps of its age in its place. Tasks send runs of ids, not ids,
    to the state of a symbol, which is its gaps, packed by blocks of ids (needs the RocksDB state store). Ids behind the watermark may count or not.
    """
    from pyspark.sql.streaming import StatefulProcessor

    runs = stream.select(F.col("symbol").cast("string"), F.col("trade_id").cast("long"), F.col(arrived).alias("_at")).mapInArrow(id_runs, "symbol string, first_id long, last_id long, _at timestamp")
    marked = runs.withWatermark("_at", lateness).where(F.when(F.col("symbol").isNotNull(), F.col("_at")).isNotNull())
    processor = type("GapProcessor", (_GapSet, StatefulProcessor), {"delay_ms": delay_ms})()
    asked = marked.select("symbol", "first_id", "last_id", F.unix_millis("_at").alias("arrived"), "_at")
    return asked.groupBy("symbol").transformWithStateInPandas(processor, "symbol string, after_id long, before_id long, missing long, change int, at_ms long", "Append", "EventTime")


def open_gaps(changes: DataFrame) -> DataFrame:
    """The gaps that are reported and not taken back."""
    net = changes.groupBy("symbol", "after_id", "before_id", "missing").agg(F.sum("change").alias("n"))
    return net.where("n > 0").drop("n")


def stream_bars(stream: DataFrame, tf_ms: int, delay: str = "10 minutes") -> DataFrame:
    """Tumbling bars: a late trade within ``delay`` updates its bar, later ones are dropped."""
    at = F.struct("ts_ms", "trade_id")
    marked = stream if stream.isStreaming is False else stream.withWatermark("ts", delay)
    return (
        marked.groupBy(F.window("ts", f"{tf_ms} milliseconds").alias("w"), "symbol")
        .agg(
            F.min_by("n_price", at).alias("open"), F.max("n_price").alias("high"), F.min("n_price").alias("low"), F.max_by("n_price", at).alias("close"), F.sum("n_qty").alias("volume"),
            F.sum(signed_qty("n_qty", "is_sell")).alias("delta"), F.count(F.lit(1)).alias("n_trades"), F.min("ts_ms").alias("open_time"), F.max("ts_ms").alias("last_trade_time"), *_moments(),
        )
        .select("symbol", F.unix_millis("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume", "delta", "n_trades", "open_time", "last_trade_time", "pq", "ppq")
    )


def _moments() -> list[Column]:
    """Exact sums of price x quantity and price^2 x quantity."""
    price, qty = F.col("n_price").cast("decimal(19,0)"), F.col("n_qty").cast("decimal(9,0)")
    return [F.sum(price * qty).alias("pq"), F.sum((price * price).cast("decimal(28,0)") * qty).alias("ppq")]


def stream_profiled_bars(stream: DataFrame, tf_ms: int, scale: int, delay: str = "10 minutes") -> DataFrame:
    """Closed bars (append mode) with ``pq, ppq`` and ``levels, volumes`` of their profile, from trades in one streaming query.

    Two windowed aggregations follow each other: cells by (bar, level), which carry their first and last trade, and bars over cells, so that no join of two
    streams is needed. A bar is final once the watermark passes its end. Rows without a symbol are a feed's heartbeats: they move the watermark, and
    so close bars of quiet markets, and nothing else.
    """
    # the condition reads ts, as one that does not would be moved below the watermark, which then misses the heartbeats
    marked = (stream.withWatermark("ts", delay) if stream.isStreaming else stream).where(F.when(F.col("symbol").isNotNull(), F.col("ts")).isNotNull())
    tick = F.struct("ts_ms", "trade_id", "n_price")
    cells = marked.groupBy(F.window("ts", f"{tf_ms} milliseconds").alias("w"), "symbol", price_level("n_price", scale).alias("level")).agg(
        F.min(tick).alias("first"), F.max(tick).alias("last"), F.max("n_price").alias("high"), F.min("n_price").alias("low"), F.sum("n_qty").alias("volume"),
        F.sum(signed_qty("n_qty", "is_sell")).alias("delta"), F.count(F.lit(1)).alias("n_trades"), *_moments(),
    )
    again = F.window(F.window_time("w"), f"{tf_ms} milliseconds") if stream.isStreaming else F.col("w")
    bars = cells.groupBy(again.alias("b"), "symbol").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), *[fn(x).alias(x) for fn, x in ((F.max, "high"), (F.min, "low"), (F.sum, "volume"), (F.sum, "delta"), (F.sum, "n_trades"), (F.sum, "pq"), (F.sum, "ppq"))],
        F.array_sort(F.collect_list(F.struct("level", F.col("volume").alias("v")))).alias("p"),
    )
    return bars.select(
        "symbol", F.unix_millis("b.start").alias("bar_start"), F.col("first.n_price").alias("open"), "high", "low", F.col("last.n_price").alias("close"), "volume", "delta", "n_trades",
        F.col("first.ts_ms").alias("open_time"), F.col("last.ts_ms").alias("last_trade_time"), "pq", "ppq", F.col("p.level").alias("levels"), F.col("p.v").alias("volumes"),
    )


def stream_cells(stream: DataFrame, tf_ms: int, scale: int, delay: str = "10 minutes") -> DataFrame:
    marked = stream.withWatermark("ts", delay) if stream.isStreaming else stream
    sell, qty = F.col("is_sell"), F.col("n_qty")
    grouped = marked.groupBy(F.window("ts", f"{tf_ms} milliseconds").alias("w"), "symbol", price_level("n_price", scale).alias("level"))
    return grouped.agg(F.sum(F.when(sell, qty).otherwise(0)).alias("bid_qty"), F.sum(F.when(sell, 0).otherwise(qty)).alias("ask_qty")).select("symbol", F.unix_millis("w.start").alias("bar_start"), "level", "bid_qty", "ask_qty")


CLOSED = (
    "symbol string, session_no long, session_start long, bar_start long, bar_idx long, open long, high long, low long, close long, volume long, delta long, n_trades long, open_time long, last_trade_time long, "
    "is_filled boolean, cvd long, vwap long, vwap_up long, vwap_low long, true_range long, park_term long, atr long, parkinson long, ma_volume long, ma_trades long, ma_trade_size long, "
    "poc long, vah long, val long, session_poc long, session_vah long, session_val long"
)
_CLOSED = [f.split()[0] for f in CLOSED.split(", ")]


class _Session:
    """A symbol's closing state: its session, the sums and recurrences of it, its profile, and the last rows for the averages."""

    def __init__(self, settings: dict, kept: dict | None, profile: dict[int, int], recent: list[tuple[int, int]]):
        self.o, self.s, self.profile, self.recent = settings, kept, profile, recent
        self.fresh, self.changed = False, set()

    def feed(self, bar: dict) -> Iterator[dict]:
        """The rows that a closed bar gives: bars without trades up to it, and itself. A bar that is not after the last one is an error: its input was not in order."""
        tf, length = self.o["tf"], self.o["tf"] * self.o["bar_count"]
        at, s = bar["bar_start"], self.s
        if s and at <= s["last"]:
            raise ValueError(f"bar {at} of {bar['symbol']} came after bar {s['last']}")
        if s and at >= s["start"] + length:
            yield from self._empty(s["start"] + length)
        if not s or at >= s["start"] + length:
            self.s = {"no": s["no"] + 1 if s else 0, "start": at, "last": at - tf, "cvd": 0, "w": 0, "pq": 0, "ppq": 0, "atr": None, "park": None, "close": None}
            self.profile, self.fresh, self.changed = {}, True, set()
        yield from self._empty(at)
        yield self._row(bar)

    def _empty(self, until: int) -> Iterator[dict]:
        for at in range(self.s["last"] + self.o["tf"], until, self.o["tf"]):
            px = self.s["close"]
            yield self._row({"bar_start": at, "open": px, "high": px, "low": px, "close": px, "volume": 0, "delta": 0, "n_trades": 0, "open_time": at, "last_trade_time": at, "pq": 0, "ppq": 0, "levels": [], "volumes": []})

    def _row(self, bar: dict) -> dict:
        s, o, scale = self.s, self.o, self.o["scale"]
        filled, high, low, before = bar["n_trades"] == 0, bar["high"], bar["low"], s["close"]
        spread = high - low if before is None else max(high - low, abs(high - before), abs(low - before))
        term = round(math.log(high / low) ** 2 * 1_000_000_000) if low > 0 and high > 0 else 0
        for name, value, period in (("atr", spread, o["atr_period"]), ("park", term, o["park_period"])):
            if s[name] is None:
                s[name] = value
            elif not filled:
                s[name] = (s[name] * (period - 1) + value) // period
        for name, value in (("cvd", bar["delta"]), ("w", bar["volume"]), ("pq", int(bar["pq"])), ("ppq", int(bar["ppq"]))):
            s[name] += value
        row = {k: bar[k] for k in ("bar_start", "open", "high", "low", "close", "volume", "delta", "n_trades", "open_time", "last_trade_time")}
        row |= {"session_no": s["no"], "session_start": s["start"], "bar_idx": (bar["bar_start"] - s["start"]) // o["tf"], "is_filled": filled, "cvd": s["cvd"], "true_range": spread, "park_term": term, "atr": s["atr"], "parkinson": s["park"]}
        if s["w"]:
            weight = float(s["w"])
            mean = float(s["pq"]) / weight
            spread_ = o["k"] * math.sqrt(max(0.0, float(s["ppq"]) / weight - mean * mean))
            row |= {"vwap": round(mean), "vwap_up": round(mean + spread_), "vwap_low": round(mean - spread_)}
        last = self.recent
        if len(last) >= o["ma"]:
            sizes = [x // n for x, n in last if n]
            row |= {"ma_volume": sum(x for x, _ in last) // o["ma"], "ma_trades": sum(n for _, n in last) // o["ma"], "ma_trade_size": sum(sizes) // len(sizes) if sizes else None}
        self.recent = [*last, (int(bar["volume"]), int(bar["n_trades"]))][-o["ma"] :]
        if not filled:
            own = dict(zip(map(int, bar["levels"]), map(int, bar["volumes"]), strict=True))
            for level, volume in own.items():
                self.profile[level] = self.profile.get(level, 0) + volume
            self.changed |= own.keys()
            for names, profile, open_edges in ((("poc", "vah", "val"), own, False), (("session_poc", "session_vah", "session_val"), self.profile, True)):
                levels = sorted(profile, reverse=True)
                places = np.array([(levels[0] - x) // scale for x in levels])
                row |= {n: levels[0] - i * scale for n, i in zip(names, grow_area(places, np.array([profile[x] for x in levels]), open_edges), strict=True)}
        s["last"], s["close"] = bar["bar_start"], bar["close"]
        return row


_SUMS = {"no": int, "start": int, "last": int, "cvd": int, "w": int, "pq": str, "ppq": str, "atr": int, "park": int, "close": int}


class _CloseState:
    """Keeps each symbol's ``_Session`` between triggers: its sums as one value, its profile as a map by level of which changed levels are written, the last rows as a list."""

    settings: dict = {}

    def init(self, handle) -> None:
        self.sums = handle.getValueState("sums", ", ".join(f"{k} {'string' if t is str else 'long'}" for k, t in _SUMS.items()))
        self.profile = handle.getMapState("profile", "level long", "volume long")
        self.recent = handle.getListState("recent", "volume long, n_trades long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        kept, profile, recent = None, {}, []
        if self.sums.exists():
            kept = {k: int(x) for k, x in zip(_SUMS, self.sums.get(), strict=True)}
            profile = {int(k[0]): int(x[0]) for k, x in self.profile.iterator()}
            recent = [(int(x[0]), int(x[1])) for x in self.recent.get()]
        own = _Session(self.settings, kept, profile, recent)
        bars = pd.concat(list(rows)).sort_values("bar_start").to_dict("records")
        made = [row | {"symbol": key[0]} for bar in bars for row in own.feed(bar)]
        if own.fresh:
            self.profile.clear()
        for level in own.changed:
            self.profile.updateValue((level,), (own.profile[level],))
        self.sums.update(tuple(t(own.s[k]) for k, t in _SUMS.items()))
        self.recent.put(own.recent)
        out = pd.DataFrame(made, columns=_CLOSED)
        yield out.astype({c: "Int64" for c in _CLOSED if c not in ("symbol", "is_filled")} | {"is_filled": bool})

    def close(self) -> None:
        pass


def stream_close_bars(bars: DataFrame, tf_ms: int, scale: int, bar_count: int, atr_period: int = 14, park_period: int = 12, ma: int = 21, k: int = 2) -> DataFrame:
    """The full bar table of a stream of closed bars: bars without trades, CVD, VWAP bands, ATR, Parkinson, averages, value areas of bar and session.

    ``bars`` are final (append mode), with ``pq, ppq`` and ``levels, volumes`` of their profile: those of ``stream_profiled_bars`` in the same query, or read from a
    table (``with_profiles``). A symbol's state is its session so far and the last ``ma`` rows (needs the RocksDB state store). Bars out of order stop the stream.
    """
    from pyspark.sql.streaming import StatefulProcessor

    settings = {"tf": tf_ms, "scale": scale, "bar_count": bar_count, "atr_period": atr_period, "park_period": park_period, "ma": ma, "k": k}
    processor = type("CloseProcessor", (_CloseState, StatefulProcessor), {"settings": settings})()
    asked = bars.select("symbol", "bar_start", "open", "high", "low", "close", "volume", "delta", "n_trades", "open_time", "last_trade_time", F.col("pq").cast("string").alias("pq"), F.col("ppq").cast("string").alias("ppq"), "levels", "volumes")
    return asked.groupBy("symbol").transformWithStateInPandas(processor, CLOSED, "Append", "None")


def with_profiles(bars: DataFrame, cells: DataFrame) -> DataFrame:
    """Closed ``bars`` with ``levels`` and ``volumes`` of their cells."""
    listed = cells.groupBy("symbol", "bar_start").agg(F.array_sort(F.collect_list(F.struct("level", (F.col("bid_qty") + F.col("ask_qty")).alias("v")))).alias("p"))
    return bars.join(listed, ["symbol", "bar_start"]).withColumns({"levels": F.col("p.level"), "volumes": F.col("p.v")}).drop("p")


def stream_signals(bars: DataFrame, rule, fields: list) -> DataFrame:
    """``fields`` of the closed bars (append mode) that meet ``rule``."""
    return bars.where(rule).select(*fields)


def lag_filter(signals: DataFrame, now_ms, max_lag_ms: int = 60_000) -> DataFrame:
    """Signals whose processing lags their trade by less than ``max_lag_ms``; ``now_ms`` is a column or the current time."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    return signals.where(now - F.col("ts_ms") < max_lag_ms)


def lag_warnings(signals: DataFrame, now_ms, max_lag_ms: int = 60_000) -> DataFrame:
    """Symbols with two or more lagging signals."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    return signals.where(now - F.col("ts_ms") >= max_lag_ms).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def account_state(order_events: DataFrame, balance_events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The latest order event of each (symbol, side), and the latest balances, of decoded events (``account, seq`` order them)."""
    keyed = order_events.withColumn("side", position_side()).where("side IS NOT NULL")
    last = keyed.groupBy("account", "symbol", "side").agg(F.max_by(F.struct("ts_ms", "order_param", "order_id", "n_price", "n_qty"), F.struct("ts_ms", "seq")).alias("e")).select("account", "symbol", "side", "e.*")
    positions = last.select("account", "symbol", "side", position_state().alias("state"), "ts_ms", "order_param", "order_id", "n_price", "n_qty")
    balances = balance_events.groupBy("account").agg(F.max_by(F.struct("ts_ms", "n_balance", "n_available", "n_locked"), F.struct("ts_ms", "seq")).alias("b")).select("account", "b.*")
    return positions, balances


def run_available(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, fn: Callable | None = None):
    """Run a stream over what is there and stop: into a memory table ``name``, or through ``fn``."""
    w = df.writeStream.outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = (w.foreachBatch(fn) if fn else w.format("memory").queryName(name)).start()
    q.awaitTermination()
    return q

"""Trade files, and partitioned Parquet stores of trades, bars and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import MONEY, utc_date_str
from .snapshots import SnapshotStore, latest_of, missing_rows

TRADE_CSV = "trade_id bigint, price decimal(38,12), qty decimal(38,12), first_id bigint, last_id bigint, ts_ms bigint, is_sell boolean"


def read_trades_csv(spark: SparkSession, path: str, schema: str = TRADE_CSV) -> DataFrame:
    """Raw daily trades with a header: the id, price, quantity, time and buyer-is-maker columns."""
    return spark.read.schema(schema).csv(path, header=True).select("trade_id", "price", "qty", "ts_ms", "is_sell")


def read_store(spark: SparkSession, path: str, table: str = "trades") -> DataFrame | None:
    """A store's table as of its latest snapshot, or None before the first."""
    return SnapshotStore(spark, path).read(table)


def append_trades(df: DataFrame, path: str) -> int:
    """Add the trades whose (symbol, id) the store lacks, days that it has in part included, as one snapshot.

    Days are folders; a large day is spread over tasks (and files) by AQE and not written by one.
    """
    dated = df.withColumn("trade_date", F.to_date(utc_date_str("ts_ms")))
    parts = ["symbol", "trade_date"]
    made = lambda read: {"trades": missing_rows(dated, read("trades"), parts, ["trade_id"]).hint("rebalance", *parts)}
    return SnapshotStore(df.sparkSession, path).commit(made, {"trades": parts})


def scan_trades(spark: SparkSession, path: str, symbol: str, start: str, end: str) -> DataFrame:
    """A symbol's trades of the days from ``start`` to ``end``, both included; other folders are not read."""
    stored = read_store(spark, path)
    if stored is None:
        raise FileNotFoundError(f"no snapshot at {path}")
    return stored.where((F.col("symbol") == symbol) & F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def write_bars(bars: DataFrame, path: str, timeframe_ms: int) -> int:
    """Add the bars that the store lacks, by (symbol, timeframe, date), as one snapshot; stored ones stay as they are."""
    dated = bars.withColumns({"timeframe_ms": F.lit(timeframe_ms), "bar_date": F.to_date(utc_date_str("bar_start"))})
    parts = ["symbol", "timeframe_ms", "bar_date"]
    made = lambda read: {"bars": missing_rows(dated, read("bars"), parts, ["bar_start"]).hint("rebalance", "symbol", "bar_date")}
    return SnapshotStore(bars.sparkSession, path).commit(made, {"bars": parts})


def find_bar_span(spans: DataFrame, start: str, end: str, symbol: str | None = None, timeframe_ms: int | None = None) -> DataFrame:
    """The stored span (``symbol, timeframe_ms, start_date, end_date``) that covers a request: the shortest, or no row."""
    covering = spans.where((F.col("start_date") <= F.lit(start).cast("date")) & (F.col("end_date") >= F.lit(end).cast("date")))
    if symbol is not None:
        covering = covering.where(F.col("symbol") == symbol)
    if timeframe_ms is not None:
        covering = covering.where(F.col("timeframe_ms") == timeframe_ms)
    length = F.datediff("end_date", "start_date")
    best = F.min_by(F.struct("start_date", "end_date"), F.struct(length, "start_date"))
    return covering.groupBy("symbol", "timeframe_ms").agg(best.alias("b")).select("symbol", "timeframe_ms", "b.*")


def slice_bars(bars: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Bars with open_time from ``start_ms`` to ``end_ms`` plus a day, both included."""
    return bars.where(F.col("open_time").between(start_ms, end_ms + 86_400_000))


def bars_to_ohlc(bars: DataFrame, price_mult: int) -> DataFrame:
    return bars.select("symbol", F.col("open_time").alias("ts_ms"), *[(F.col(c) / price_mult).alias(c) for c in ("open", "high", "low", "close")])


def write_run(fills: DataFrame, equity: DataFrame, path: str) -> int:
    """Fills and equity of runs as one snapshot, by run_id; readers see a run's last commit, of both tables or of neither."""
    made = lambda read: {name: df.hint("rebalance", "run_id") for name, df in (("fills", fills), ("equity", equity))}
    return SnapshotStore(fills.sparkSession, path).commit(made, {"fills": ["run_id"], "equity": ["run_id"]})


def read_run_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """``fills`` or ``equity`` of all runs, each as it was last written."""
    return latest_of(SnapshotStore(spark, path).read(table, order="_commit"), ["run_id"], "_commit")


def commit_manifest(new: DataFrame, path: str) -> int:
    """``upsert_manifest`` of the stored list of runs and ``new``, as one snapshot that replaces the list."""

    def made(read) -> dict[str, DataFrame]:
        runs = read("manifest")
        return {"manifest": upsert_manifest(new.where("false") if runs is None else runs, new)}

    return SnapshotStore(new.sparkSession, path).commit(made, replace=True)


def upsert_manifest(runs: DataFrame, new: DataFrame) -> DataFrame:
    """``runs`` with ``new``: run 0 resets the list, an id that exists is replaced, others are added; balances to two decimals."""
    rounded = new.withColumns({c: F.bround(c, 2) for c in ("start_balance", "end_balance", "net_profit") if c in new.columns})
    reset = new.where("run_id = 0").select(F.lit(1).alias("_reset")).limit(1)
    kept = runs.join(new.select("run_id"), "run_id", "left_anti").join(reset, F.lit(True), "left_anti")
    return kept.unionByName(rounded)


def scale_equity(equity: DataFrame, money: int = MONEY) -> DataFrame:
    """Equity integers to money; rows with time 0 are padding and go."""
    return equity.where("ts_ms > 0").select("run_id", "ts_ms", *[(F.col(c) / money).alias(c) for c in ("open", "high", "low", "close")])

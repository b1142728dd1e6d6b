"""JSON messages to rows. Each decoder takes a DataFrame with a string column ``message`` and keeps its other columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ORDER_FLAGS

TRADE = "struct<p:string,q:string,T:bigint,m:boolean,a:bigint>"
ENVELOPE = "struct<topic:string,data:array<struct<p:string,v:string,S:string,T:bigint,a:bigint>>>"
ITEMS = "array<struct<a:string,wb:string,cw:string,bc:string>>"
#: Field names of events differ in case only (e, E), which a struct cannot hold; a map can.
FIELDS = "map<string,string>"
INSTRUMENTS = "struct<symbols:array<struct<symbol:string,filters:array<struct<filterType:string,tickSize:string,stepSize:string,notional:string>>>>>"


@dataclass(frozen=True)
class TradeDecoder:
    """A message format: an array of trade structs from a message, and the five columns from one trade ``t``."""

    rows: str
    price: str
    qty: str
    ts_ms: str
    is_sell: str
    agg_id: str


DECODERS = {
    # one trade object, or an array of them
    "object": TradeDecoder(f"if(ltrim(message) LIKE '[%', from_json(message, 'array<{TRADE}>'), array(from_json(message, '{TRADE}')))", "t.p", "t.q", "t.T", "t.m", "t.a"),
    # a topic with an array of trades whose side is text
    "envelope": TradeDecoder(f"from_json(message, '{ENVELOPE}').data", "t.p", "t.v", "t.T", "upper(t.S) = 'SELL'", "t.a"),
}


def register_decoder(name: str, decoder: TradeDecoder) -> None:
    DECODERS[name] = decoder


def decode_agg_trades(df: DataFrame, kind: str) -> DataFrame:
    """``price, qty`` (text), ``ts_ms, is_sell, agg_id`` of each trade of each message; undecodable messages give no rows."""
    d = DECODERS[kind]
    rest = [c for c in df.columns if c != "message"]
    rows = df.select(*rest, F.explode(F.expr(d.rows)).alias("t")).where("t IS NOT NULL")
    out = rows.select(*rest, F.expr(d.price).alias("price"), F.expr(d.qty).alias("qty"), F.expr(d.ts_ms).alias("ts_ms"), F.expr(d.is_sell).alias("is_sell"), F.expr(d.agg_id).alias("agg_id"))
    return out.where("price IS NOT NULL AND qty IS NOT NULL AND ts_ms IS NOT NULL AND is_sell IS NOT NULL AND agg_id IS NOT NULL")


def _decodes(kind: str) -> Column:
    d = DECODERS[kind]
    whole = " AND ".join(f"({x}) IS NOT NULL" for x in ("t", d.price, d.qty, d.ts_ms, d.is_sell, d.agg_id))
    return F.expr(f"coalesce(size({d.rows}) > 0 AND forall({d.rows}, t -> {whole}), false)")


def split_bad_messages(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Messages that decode, and those that do not."""
    ok = _decodes(kind)
    return df.where(ok), df.where(~ok)


def scale_trades(df: DataFrame, price_mult: int, qty_mult: int, mode: str = "exact") -> DataFrame:
    """``n_price, n_qty`` from price and qty. exact: decimal arithmetic, halves away from zero; trunc and round (half even): on doubles."""

    def scaled(c: str, mult: int) -> Column:
        if mode == "exact":
            return F.round(F.col(c).cast("decimal(38,12)") * mult).cast("long")
        value = F.col(c).cast("double") * mult
        return (value if mode == "trunc" else F.bround(value)).cast("long")

    return df.withColumns({"n_price": scaled("price", price_mult), "n_qty": scaled("qty", qty_mult)})


def decode_order_events(df: DataFrame, price_mult: int = 100, qty_mult: int = 1000, money: int = 10**8, id_prefix: str = "im_") -> DataFrame:
    """Order updates: flag mask, ids (0 without the prefix), scaled price, quantity and commission; event time where there is no order time."""
    rest = [c for c in df.columns if c != "message"]
    e = df.withColumn("_m", F.from_json("message", FIELDS)).where("_m['e'] = 'ORDER_TRADE_UPDATE'")
    e = e.withColumn("_o", F.from_json(F.col("_m")["o"], FIELDS)).where("_o IS NOT NULL")
    o = lambda k: F.col("_o")[k]
    bit = lambda k, *pairs: sum((F.when(o(k).isin(*v), ORDER_FLAGS[f]).otherwise(0) for f, v in pairs), F.lit(0))
    mask = (
        bit("ps", ("LONG", ["LONG"]), ("SHORT", ["SHORT"])) + bit("S", ("BUY", ["BUY"]), ("SELL", ["SELL"])) + bit("o", ("LIMIT", ["LIMIT"]), ("MARKET", ["MARKET"]))
        + bit("X", ("NEW", ["NEW"]), ("FILLED", ["FILLED", "PARTIALLY_FILLED"]), ("CANCELED", ["CANCELED", "EXPIRED", "REJECTED"]))
    )
    own = F.nullif(F.regexp_extract(o("c"), f"^{id_prefix}([0-9]+)", 1), F.lit("")).try_cast("long")
    scaled = lambda k, m: F.round(o(k).cast("decimal(38,12)") * m).cast("long")
    return e.select(
        *rest, F.coalesce(F.nullif(o("T").cast("long"), F.lit(0).cast("long")), F.col("_m")["E"].cast("long")).alias("ts_ms"), mask.cast("long").alias("order_param"), o("i").cast("long").alias("order_id"),
        F.coalesce(own, F.lit(0).cast("long")).alias("client_order_id"), scaled("p", price_mult).alias("n_price"), scaled("q", qty_mult).alias("n_qty"), scaled("n", money).alias("n_commission"), o("s").alias("symbol"),
    )


def decode_balance_events(df: DataFrame, asset: str = "USDT", money: int = 10**8) -> DataFrame:
    """The first balance item of ``asset``: balance, available, and locked = max(0, balance - available)."""
    e = df.withColumn("_m", F.from_json("message", FIELDS)).where("_m['e'] = 'ACCOUNT_UPDATE'")
    items = F.from_json(F.from_json(F.col("_m")["a"], FIELDS)["B"], ITEMS)
    e = e.withColumn("_b", F.get(F.filter(items, lambda b: b["a"] == asset), F.lit(0))).where("_b IS NOT NULL")
    scaled = lambda c: F.round(F.col(c).cast("decimal(38,12)") * money).cast("long")
    out = e.select(*[c for c in df.columns if c != "message"], F.col("_m")["E"].cast("long").alias("ts_ms"), scaled("_b.wb").alias("n_balance"), scaled("_b.cw").alias("n_available"))
    return out.withColumn("n_locked", F.greatest(F.lit(0).cast("long"), F.col("n_balance") - F.col("n_available")))


def parse_instruments(df: DataFrame) -> DataFrame:
    """``symbol, tick_size, lot_size, min_notional`` from exchange information."""
    s = df.select(F.explode(F.from_json("message", INSTRUMENTS)["symbols"]).alias("s")).select("s.symbol", F.explode_outer("s.filters").alias("f"))
    pick = lambda kind, c: F.max(F.when(F.col("f.filterType") == kind, F.col(f"f.{c}")))
    return s.groupBy("symbol").agg(pick("PRICE_FILTER", "tickSize").alias("tick_size"), pick("LOT_SIZE", "stepSize").alias("lot_size"), pick("MIN_NOTIONAL", "notional").cast("double").alias("min_notional"))

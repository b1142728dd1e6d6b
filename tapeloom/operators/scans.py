"""Running values, and chains of pointers, along an order that is cut into blocks, so that no task holds a whole run or symbol."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import floor_div
from ..sources.scratch import stored

#: Rows of a block where blocks go by whole numbers, and its milliseconds where they go by time.
ROWS, SPAN = 4096, 7 * 86_400_000


def scan(df: DataFrame, keys: list[str], order: list[str], width: int, values: dict[str, tuple[str, str | Column]]) -> DataFrame:
    """``df`` with running values along ``order`` within ``keys``.

    ``values`` names outputs with a kind and a column: ``sum`` and ``max`` up to and with the row, ``rank`` from 1 (of rows; the column is not read), ``lag`` the value of the row before,
    and ``fill`` the last value that is not null. Blocks are ranges of ``width`` of the first column of ``order``, a whole number. Windows run inside blocks, and what the
    blocks before amount to, one row a block, is added.
    """
    order_ = [F.col(x) for x in order]
    cut = df.withColumn("_block", floor_div(F.col(order[0]), width))
    by = Window.partitionBy(*keys, "_block").orderBy(*order_)
    upto, at = by.rowsBetween(Window.unboundedPreceding, 0), F.struct(*order_)
    inside, whole, before = {"_first": F.row_number().over(by)}, [], []
    passed = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    for i, (kind, column) in enumerate(values.values()):
        x, b = F.col(column) if isinstance(column, str) else column, f"_b{i}"
        if kind == "sum":
            inside[f"_v{i}"], total, carried = F.sum(x).over(upto), F.sum(x), F.sum(b).over(passed)
        elif kind == "max":
            inside[f"_v{i}"], total, carried = F.max(x).over(upto), F.max(x), F.max(b).over(passed)
        elif kind == "rank":
            inside[f"_v{i}"], total, carried = F.row_number().over(by).cast("long"), F.count(F.lit(1)), F.sum(b).over(passed)
        elif kind == "lag":
            inside[f"_v{i}"], total, carried = F.lag(x).over(by), F.max_by(x, at), F.lag(b).over(Window.partitionBy(*keys).orderBy("_block"))
        elif kind == "fill":
            inside[f"_v{i}"], total, carried = F.last(x, ignorenulls=True).over(upto), F.max_by(x, F.when(x.isNotNull(), at)), F.last(b, ignorenulls=True).over(passed)
        else:
            raise ValueError(kind)
        whole.append(total.alias(b))
        before.append(carried.alias(f"_c{i}"))
    carries = cut.groupBy(*keys, "_block").agg(*whole).select(*keys, "_block", *before)
    joined = cut.withColumns(inside).join(carries, [*keys, "_block"])
    out = {}
    for i, (name, (kind, _)) in enumerate(values.items()):
        v, c = F.col(f"_v{i}"), F.col(f"_c{i}")
        made = {"sum": F.coalesce(v + c, v, c), "rank": v + F.coalesce(c, F.lit(0)), "max": F.greatest(v, c), "lag": F.when(F.col("_first") == 1, c).otherwise(v), "fill": F.coalesce(v, c)}
        out[name] = made[kind]
    return joined.withColumns(out).select(*df.columns, *[n for n in out if n not in df.columns])


def next_point(asks: DataFrame, points: DataFrame, keys: list[str], same: bool) -> DataFrame:
    """``asks`` (keys, at, ask) with ``t`` of the first of ``points`` (keys, at, t) at or after ``at`` (after it, unless ``same``), null if there is none.

    An as-of join forward: both in one column, ordered from the end, where the last point passed is the next one.
    """
    kind = F.lit(0 if same else 2)
    mixed = points.select(*keys, "at", F.lit(1).alias("kind"), "t", F.lit(None).cast(asks.schema["ask"].dataType).alias("ask")).unionByName(
        asks.select(*keys, "at", kind.alias("kind"), F.lit(None).cast(points.schema["t"].dataType).alias("t"), "ask")
    )
    passed = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("kind"), F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    return mixed.withColumn("t", F.last("t", ignorenulls=True).over(passed)).where("kind <> 1").select(*keys, "at", "ask", "t")


def next_point_by_blocks(asks: DataFrame, points: DataFrame, keys: list[str], width: int, same: bool) -> DataFrame:
    """``next_point`` within blocks of ``width`` of ``at``; where a block has none, the first of the next block that has any."""
    cut = lambda df: df.withColumn("_block", floor_div("at", width))
    near = next_point(cut(asks), cut(points), [*keys, "_block"], same)
    firsts = cut(points).groupBy(*keys, F.col("_block").alias("at")).agg(F.min(F.struct("at", "t")).alias("x")).select(*keys, "at", F.col("x.t").alias("t"))
    asked = near.where("t IS NULL").select(*keys, F.col("_block").alias("at"), F.col("_block").alias("ask")).distinct()
    far = next_point(asked, firsts, keys, False).select(*keys, F.col("ask").alias("_block"), F.col("t").alias("_far"))
    return near.join(far, [*keys, "_block"], "left").select(*keys, "at", "ask", F.coalesce("t", "_far").alias("t"))


def _plain(x):
    return tuple(x.values()) if isinstance(x, dict) else x


def _leaves(pdf: pd.DataFrame) -> Iterator[tuple]:
    """For each point of a block, from the last on, the point outside it that its chain comes to, and in how many steps."""
    found: dict = {}
    points = sorted(zip(map(_plain, pdf["at"]), pdf["at"], pdf["next"], strict=True), key=lambda x: x[0], reverse=True)
    for key, at, to in points:
        inner = None if to is None or to != to else _plain(to)
        leave, steps = found[inner] if inner in found else (to, 1)
        found[key] = (leave if leave == leave else None, steps + (inner in found))
        yield at, *found[key]


def _entries(cut: DataFrame, keys: list[str], ways_out: Callable[[pd.DataFrame], pd.DataFrame], schema: str, firsts: DataFrame) -> DataFrame:
    """``firsts`` (keys, at, no) with the points by which their chains enter later blocks, by pointer doubling."""
    group = [*keys, "_block"]
    outs = stored(cut.select(*group, "at", "next").groupBy(*group).applyInPandas(ways_out, schema).where("leave IS NOT NULL").select(*keys, "at", "leave", "steps"), "chain-outs")
    entries = firsts.select(*keys, "at").union(outs.select(*keys, F.col("leave").alias("at"))).distinct()
    jumps, reached = stored(outs.join(entries, [*keys, "at"], "left_semi"), "chain-jumps"), firsts
    while not jumps.isEmpty():
        ahead = reached.join(jumps, [*keys, "at"]).select(*keys, F.col("leave").alias("at"), (F.col("no") + F.col("steps")).alias("no"))
        reached = stored(reached.union(ahead), "chain-reached")
        onward = jumps.select(*keys, F.col("at").alias("leave"), F.col("leave").alias("_leave"), F.col("steps").alias("_steps"))
        jumps = stored(jumps.join(onward, [*keys, "leave"]).select(*keys, "at", F.col("_leave").alias("leave"), (F.col("steps") + F.col("_steps")).alias("steps")), "chain-jumps")
    return reached


def follow(pointers: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The points that the chain from each key's first point visits, ``keys, at, no`` (from 0), of ``pointers(keys, at, place, next, next_place)``.

    ``at`` tells points of a key apart and orders them (a value or a struct), ``next`` is the point that follows one in its chain, later than it, or null; blocks are ranges of ``width`` of
    the places. Inside a block, chains are walked back once, which gives each point its way out; only points that some chain enters a block by take part in pointer doubling,
    in logarithmically many rounds, each written; a last walk lists what is visited in each block.
    """
    kind, names = pointers.schema["at"].dataType.simpleString(), ", ".join(f"`{k}` {pointers.schema[k].dataType.simpleString()}" for k in keys)
    cut = stored(pointers.withColumns({"_block": floor_div("place", width), "_to": floor_div("next_place", width)}), "chain-points")
    group = [*keys, "_block"]

    def ways_out(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(list(_leaves(pdf)), columns=["at", "leave", "steps"], dtype=object)
        for k in group:
            out[k] = pdf[k].iloc[0]
        return out[[*group, "at", "leave", "steps"]].astype({"steps": "int64"})

    firsts = cut.groupBy(*keys).agg(F.min("at").alias("at"))
    reached = firsts.withColumn("no", F.lit(0).cast("long"))
    if not cut.where("_to <> _block").isEmpty():  # else all chains end in their first block
        reached = _entries(cut, keys, ways_out, f"{names}, _block long, at {kind}, leave {kind}, steps long", reached)

    def visit(pdf: pd.DataFrame) -> pd.DataFrame:
        to = dict(zip(map(_plain, pdf["at"]), pdf["next"], strict=True))
        at, no, rows = pdf["entry"].iloc[0], int(pdf["no"].iloc[0]), []
        while at is not None and at == at and _plain(at) in to:
            rows.append((at, no))
            at, no = to[_plain(at)], no + 1
        out = pd.DataFrame(rows, columns=["at", "no"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "at", "no"]]

    entered = cut.join(reached, [*keys, "at"]).select(*group, F.col("at").alias("entry"), "no")
    return cut.select(*group, "at", "next").join(entered, group).groupBy(*group).applyInPandas(visit, f"{names}, at {kind}, no long")

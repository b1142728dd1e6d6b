"""Running values by blocks, chains of pointers and the last range over a place, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import indicators
from tapeloom.operators import outcomes as out
from tapeloom.operators.flags import last_cover, range_nodes
from tapeloom.operators.indicators import assign_sessions
from tapeloom.operators.scans import follow, next_point_by_blocks, scan


def test_running_values_do_not_depend_on_blocks(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(-50, 200), i, rng.choice([None, *range(-5, 9)])) for k in "ab" for i in range(150)] + [("c", 7, 1, None), ("d", -1, 0, 4)]
    df = spark.createDataFrame(rows, "k string, t long, seq long, x long")
    values = {"s": ("sum", "x"), "m": ("max", "x"), "n": ("rank", "x"), "l": ("lag", "x"), "f": ("fill", "x")}
    want = {}
    for k in "abcd":
        seen, last, filled, total, top = 0, None, None, None, None
        for _, t, seq, x in sorted(r for r in rows if r[0] == k):
            seen += 1
            if x is not None:
                total, top, filled = (total or 0) + x, x if top is None else max(top, x), x
            want[k, t, seq] = (total, top, seen, last, filled)
            last = x
    for width in (1, 16, 100_000):
        got = {(r.k, r.t, r.seq): (r.s, r.m, r.n, r.l, r.f) for r in scan(df, ["k"], ["t", "seq"], width, values).collect()}
        assert got == want
    assert scan(df.where("false"), ["k"], ["t"], 5, values).columns == [*df.columns, *values]


def test_the_next_point_is_found_across_empty_blocks(spark):
    rng = random.Random(2)
    points = [(k, rng.randrange(0, 900, 7)) for k in "ab" for _ in range(20)]
    asks = [(k, rng.randrange(-20, 1000)) for k in "abc" for _ in range(60)]
    p = spark.createDataFrame(points, "k string, at long").withColumn("t", F.col("at"))
    a = spark.createDataFrame([(k, x, i) for i, (k, x) in enumerate(asks)], "k string, at long, ask long")
    for same in (True, False):
        want = {i: min((y for j, y in points if j == k and (y >= x if same else y > x)), default=None) for i, (k, x) in enumerate(asks)}
        assert {r.ask: r.t for r in next_point_by_blocks(a, p, ["k"], 30, same).collect()} == want


@pytest.mark.parametrize("width", [1, 13, 1000])
def test_chains_are_followed_across_blocks(spark, width):
    rng = random.Random(3)
    rows, want = [], set()
    for k in ("a", "b", "c"):
        places = sorted(rng.sample(range(-100, 400), 120)) if k != "c" else [5]
        to = {p: rng.choice([q for q in places if p < q <= p + 60] or [None]) for p in places}
        rows += [(k, (p,), p, None if to[p] is None else (to[p],), to[p]) for p in places]
        at, no = places[0], 0
        while at is not None:
            want.add((k, at, no))
            at, no = to[at], no + 1
    df = spark.createDataFrame(rows, "k string, at struct<p:long>, place long, next struct<p:long>, next_place long")
    assert {(r.k, r["at"].p, r.no) for r in follow(df, ["k"], width).collect()} == want


def test_sessions_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(indicators, "BLOCK_BARS", 64)
    rng = random.Random(4)
    at = {s: sorted({rng.randrange(0, 40_000) * 10 for _ in range(1500)}) for s in "AB"}
    bars = spark.createDataFrame([(s, x, "kept") for s in at for x in at[s]], "symbol string, bar_start long, extra string")
    want = {}
    for s, xs in at.items():
        start, no = None, -1
        for x in xs:
            if start is None or x >= start + 50:
                start, no = x, no + 1
            want[s, x] = (no, start, (x - start) // 10)
    got = assign_sessions(bars, 10, 5)
    assert {(r.symbol, r.bar_start): (r.session_no, r.session_start, r.bar_idx) for r in got.collect()} == want and "extra" in got.columns


def test_one_position_a_side_over_many_blocks(spark):
    rng = random.Random(5)
    rows = []
    for side in (True, False):
        for i in range(200):
            ts = rng.randrange(0, 3000)
            rows.append((1, "X", side, ts, f"{side}{i}", rng.choice([ts, ts + 5, ts + rng.randrange(300)]) if i % 67 or not side else None))
    want, free = set(), {}
    for _, _, side, ts, order, end in sorted(rows, key=lambda r: (r[3], r[4])):
        if ts > free.get(side, -1):
            want.add(order)
            free[side] = 10**9 if end is None else end
    df = spark.createDataFrame(rows, "run_id long, symbol string, is_long boolean, ts_ms long, order_id string, end_ts long")
    for width in (100, 10**6):
        assert {r.order_id for r in out.one_position_per_side(df, width).collect()} == want


def test_the_last_range_over_a_place(spark):
    rng = random.Random(6)
    ranges = [(k, a, a + rng.choice([0, 1, 5, 90, 1000]), i) for k in "ab" for i in range(60) for a in [rng.randrange(-300, 900)]] + [("b", 10**11, 10**13, 99)]
    points = [(k, p) for k in "abc" for p in [rng.randrange(-400, 1500) for _ in range(80)]] + [("b", 5 * 10**12)]
    r = spark.createDataFrame(ranges, "k string, low long, high long, at long")
    nodes = r.select("low", "high", range_nodes("low", "high").alias("n")).collect()
    for row in nodes:
        if row.high - row.low < 2000:
            assert sorted(x for n in row.n for x in range(n.i << n.k, (n.i + 1) << n.k)) == list(range(row.low, row.high + 1))
    assert max(len(row.n) for row in nodes) <= 2 * 44
    got = {(x.k, x.place): x.last for x in last_cover(spark.createDataFrame(points, "k string, place long"), r, ["k"]).collect()}
    assert got == {(k, p): max((i for j, a, b, i in ranges if j == k and a <= p <= b), default=None) for k, p in points}

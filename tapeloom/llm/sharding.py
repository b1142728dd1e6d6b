"""Sharding by best-fit-decreasing bin packing.

Indivisible groups (documents with equal texts) are sorted by size, and each enters the bin with the tightest remaining
capacity that still holds it, found in a balanced tree. The packing looks at sizes only, so the driver sees a histogram of group sizes, which are
exact below 2^``BITS`` bytes and rounded up to ``BITS`` significant bits above: at most 2^BITS + (63 - BITS) * 2^(BITS - 1) classes, however many
groups there are. Groups of one class are interchangeable; Spark ranks them and a range of ranks goes to each bin.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, maybe_broadcast, numbered

#: Significant bits of a size in the histogram; rounding adds less than 1 / 2^(BITS - 1) to it.
BITS = 14


class CapacityTree:
    """Ordered multiset of (remaining capacity, bin): a treap, balanced in expectation."""

    def __init__(self, seed: int = 7):
        self.root, self.rng = None, random.Random(seed)

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, remaining: int, which: int) -> None:
        left, right = self._split(self.root, (remaining, which))
        self.root = self._merge(self._merge(left, [(remaining, which), self.rng.random(), None, None]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least (remaining, bin) with remaining >= size."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            left, right = self._split(self.root, best)
            _, right = self._split(right, (best[0], best[1] + 1))
            self.root = self._merge(left, right)
        return best


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """``(size, count, bin)`` runs for ``classes`` of (size, count); opens as many bins as needed.

    After a group has entered the tightest bin, that bin is still the tightest for the next group of the same size, so
    a whole run is placed at once; the result is that of placing one by one.
    """
    tree, runs, bins = CapacityTree(), [], 0
    for size, count in sorted(classes, reverse=True):
        if size > capacity:
            raise ValueError(f"a group of {size} bytes exceeds the capacity {capacity}")
        while count:
            found = tree.take_tightest(size)
            if found is None:
                found, bins = (capacity, bins), bins + 1
            remaining, which = found
            n = min(count, remaining // size)
            runs.append((size, n, which))
            tree.add(remaining - n * size, which)
            count -= n
    return runs


def fit_shards(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """The packing into at most ``shards`` bins with the least capacity found: from the mean upwards in small steps.

    An item above the mean of what is left has a bin to itself, so that it does not raise the capacity of the others.
    """
    left, runs, used = dict(classes), [], 0
    total = sum(s * n for s, n in classes)
    while left and shards - used > 1 and max(left) > total / (shards - used):
        size = max(left)
        runs.append((size, 1, used))
        left[size] -= 1
        left = {s: n for s, n in left.items() if n}
        total, used = total - size, used + 1
    if not left:
        return runs
    least = max(-(-total // (shards - used)), max(left))
    slack = 0
    while True:
        rest = best_fit_decreasing(list(left.items()), least + slack)
        if max(b for *_, b in rest) < shards - used:
            return runs + [(s, n, b + used) for s, n, b in rest]
        slack = slack * 2 or max(1, least // 10_000)


def size_class(size: Column) -> Column:
    """``size`` rounded up to ``BITS`` significant bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))).cast("long")
    return F.ceil(size / step) * step


def blocks_of_ranks(runs: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[tuple[int, int]]]]]:
    """``(size, width)`` of each size, and ``(size, block, [(end of ranks, bin)])`` of each ``width`` ranks of it: at most twice as many ends as runs.

    A rank finds its bin by an equality join on size and block, then among the few ends there, however many bins a size is spread over.
    """
    own: dict[int, list[tuple[int, int]]] = {}
    for size, n, which in runs:
        own.setdefault(size, []).append((n, which))
    widths = [(size, max(1, sum(n for n, _ in parts) // len(parts))) for size, parts in own.items()]
    blocks: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for size, width in widths:
        start = 0
        for n, which in own[size]:
            for block in range(start // width, (start + n - 1) // width + 1):
                blocks.setdefault((size, block), []).append((start + n, which))
            start += n
    return widths, [(size, block, ends) for (size, block), ends in blocks.items()]


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, cut``: equal texts stay together and shard sizes are near equal.

    size is the UTF-8 length plus 1 (a null text has length 0, crc32 0, and groups with the empty text). A group of copies larger than the mean
    shard cannot be whole in a near-equal packing: it is ``cut``, by gapless numbers of its rows, into equal pieces of about a quarter of a shard. Fewer
    than ``shards`` groups exceed the mean, which bounds that broadcast. Repeated rows, null ids too, are packed as rows and may be cut apart.
    A single document above the mean has a shard to itself. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    # numbers of rows, fixed by being written, tell repeated rows apart
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()), "shard-base")
    total = base.agg(F.sum("size")).first()[0] or 0
    mean = total / shards
    copies = base.groupBy("digest").agg(F.sum("size").alias("gsize"), F.count(F.lit(1)).alias("n"))
    big = materialize(copies.where((F.col("gsize") > mean) & (F.col("n") > 1)).select("digest", F.ceil(F.col("gsize") * 4 / mean).alias("pieces")), "shard-big")
    parts = numbered(base.join(F.broadcast(big), "digest"), ["digest"], ["row"], "number").withColumn("piece", F.pmod("number", "pieces").cast("int"))
    columns = ["doc_id", "size", "text_crc32", "digest", "row", "piece", "cut"]
    whole = base.join(F.broadcast(big), "digest", "left_anti").withColumns({"piece": F.lit(0), "cut": F.lit(False)}).select(*columns)
    rows = whole if big.isEmpty() else materialize(whole.union(parts.withColumn("cut", F.lit(True)).select(*columns)), "shard-rows")
    groups = rows.groupBy("digest", "piece").agg(F.sum("size").alias("gsize"))
    groups = materialize(groups.select("digest", "piece", size_class(F.col("gsize")).alias("fit")), "shard-groups")
    classes = [(r[0], r[1]) for r in groups.groupBy("fit").count().collect()]  # bounded by BITS
    widths, blocks = blocks_of_ranks(fit_shards(classes, shards))
    make = docs.sparkSession.createDataFrame
    plan = make(blocks, "fit long, block long, runs array<struct<upto: long, shard: int>>")
    ranked = numbered(groups, ["fit"], ["digest", "piece"], "rank").join(F.broadcast(make(widths, "fit long, width long")), "fit")
    ranked = ranked.withColumn("block", F.expr("rank div width")).join(maybe_broadcast(plan, F.size("runs") * 16), ["fit", "block"])
    units = materialize(ranked.select("digest", "piece", F.expr("filter(runs, r -> rank < r.upto)[0].shard").alias("shard")), "shard-units")
    discard(groups)
    return numbered(rows.join(units, ["digest", "piece"]), ["shard"], ["row"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot", "cut")

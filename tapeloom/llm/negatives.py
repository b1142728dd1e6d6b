"""Hard-negative mining: exact searches by inner product with LEMP-style coordinate pruning.

Rows are dealt to buckets by vector length. A bucket holds, next to its vectors, the order of its rows by each coordinate of the unit vectors.
For an anchor q and a score that is worth finding, the angle between q and a useful row of a bucket is bounded, and with it the range of each
coordinate. The ranges of the anchor's largest (focus) coordinates are found by binary search in the sorted lists, and the rows inside all of
them are the candidates, whose integer scores are then computed exactly. Where ranges leave more than half of a bucket, its rows are scored by one matrix product.

The anchors are a stated query set: groups of anchors meet groups of buckets (``cogroup``), so a task holds a bounded number of both, and only
the best rows of each anchor leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A component x becomes floor(SCALE * x), held within +-LIMIT so that sums of 8,192 products fit 64 bits.
SCALE, LIMIT = 256, 1 << 25
#: Most rows of a bucket, most partitions that buckets are made in, and buckets that a task holds at once.
BUCKET, PARTS, TASK_BUCKETS = 4096, 20_000, 16
#: Anchors of a group, anchors searched at once, and anchors of the group that give the first bounds.
GROUP, SLAB, SEED = 16_384, 512, 2048
#: Coordinates of an anchor whose ranges are intersected.
FOCUS = 4
FAR = np.iinfo(np.int64)

_INDEX = "bucket long, dim int, ids binary, labels binary, vectors binary, orders binary"
_FOUND = "a_bucket long, a_pos int, slot int, score long, id long"


def clean_rows(vectors: DataFrame) -> DataFrame:
    """``id, label, vec array<int>, norm2`` of the rows that take part: no null id, label, vector or component, and finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    vec = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * SCALE))).cast("int"))
    rows = rows.select("id", "label", vec.alias("vec"))
    return rows.withColumn("norm2", F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x))


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zeros stay) and lengths."""
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    return vectors / np.maximum(norms, 1.0)[:, None] if len(vectors) else vectors.astype(np.float64), norms


def _matrix(vecs: list[np.ndarray], dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones are led on with zeros."""
    out = np.zeros((len(vecs), dim), np.int32)
    for i, v in enumerate(vecs):
        out[i, : len(v)] = v
    return out


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by falling length to buckets of at most BUCKET rows."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids, labels, vecs = [], [], []

    def packed() -> pa.RecordBatch:
        nonlocal number, ids, labels, vecs
        m = _matrix(vecs, max(map(len, vecs)))
        orders = np.argsort(_unit(m)[0], axis=0, kind="stable").T.astype(np.uint16)
        row = [number, m.shape[1], np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(), m.tobytes(), np.ascontiguousarray(orders).tobytes()]
        number, ids, labels, vecs = number + 1, [], [], []
        return pa.record_batch([pa.array([x]) for x in row], names=[c.split()[0] for c in _INDEX.split(", ")]).cast(_schema(_INDEX))

    for batch in batches:
        flat, offsets = batch.column("vec").flatten().to_numpy(), batch.column("vec").offsets.to_numpy()
        offsets = offsets - offsets[0]
        for i, (a, b) in enumerate(zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
            ids.append(a)
            labels.append(b)
            vecs.append(flat[offsets[i] : offsets[i + 1]].copy())
            if len(ids) == BUCKET:
                yield packed()
    if ids:
        yield packed()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def build_index(rows: DataFrame) -> DataFrame:
    """The buckets of ``clean_rows``, a written table. A range of lengths is one partition; equal lengths are told apart by a hash of the id."""
    parts = max(1, min(PARTS, -(-rows.count() * 4 // (3 * BUCKET))))
    dealt = rows.repartitionByRange(parts, F.desc("norm2"), F.xxhash64("id")).sortWithinPartitions(F.desc("norm2"), "id")
    return materialize(dealt.select("id", "label", "vec").mapInArrow(_build, _INDEX), "negatives-index")


def _anchor_rows(every: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Bucket(row)
                at = np.flatnonzero(b.ids % every == 0)
                cols = [pa.array(np.full(len(at), b.number)), pa.array(at.astype(np.int32)), pa.array(b.ids[at]), pa.array(b.labels[at]), pa.array([b.vectors[i].tobytes() for i in at], pa.binary())]
                yield pa.record_batch(cols, names=["a_bucket", "a_pos", "anchor_id", "label", "vec"])

    return run


class Bucket:
    """Rows of similar length, with the sorted lists of their unit coordinates."""

    def __init__(self, row: dict):
        self.number, self.ids, self.labels = row["bucket"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        n = len(self.ids)
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(n, row["dim"])
        self.orders = np.frombuffer(row["orders"], np.uint16).reshape(row["dim"], n)

    def open(self) -> Bucket:
        self.unit, self.norms = _unit(self.vectors)
        self.real, self.most = self.vectors.astype(np.float64), int(np.abs(self.vectors).max(initial=0))
        return self

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Bucket:
        orders = np.ascontiguousarray(np.argsort(_unit(vectors)[0], axis=0, kind="stable").T.astype(np.uint16))
        return cls({"bucket": -1, "dim": vectors.shape[1], "ids": ids.tobytes(), "labels": labels.tobytes(), "vectors": vectors.tobytes(), "orders": orders.tobytes()}).open()


class Search:
    """The best rows of a slab of anchors, by slots (score ranges) of each; better is a higher score, then a smaller id."""

    def __init__(self, bucket: np.ndarray, pos: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, best: int):
        self.bucket, self.pos, self.labels, self.vectors, self.same, self.best = bucket, pos, labels, vectors, same, best
        self.real, self.most, (self.unit, self.norms) = vectors.astype(np.float64), int(np.abs(vectors).max(initial=0)), _unit(vectors)
        self.low, self.high = low.copy(), high
        self.last_id = np.full(low.shape, FAR.max)
        k = min(FOCUS, vectors.shape[1])
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :k]
        self.hits = [np.empty(0, np.int64)] * 3

    def seed(self, bucket: Bucket, own: np.ndarray) -> None:
        """Raise the bounds to what ``bucket``, some of the rows searched, has; its hits are not kept, as its rows are met again."""
        other = Search(np.full(len(own), -1), own, self.labels, self.vectors, self.low, self.high, self.same, self.best)
        other.scan(bucket)
        self.low = other.low

    def ranges(self, bucket: Bucket) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which anchors need the bucket at all, and the feasible values of their focus coordinates."""
        need = np.where(self.low <= self.high, self.low, FAR.max).min(1)
        reach = self.norms * bucket.norms.max(initial=0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(need > 0, need / reach, -1.0)  # the least cosine of a row worth finding
        live = (need < FAR.max) & ~(least > 1 + 1e-9)
        turn = np.where(least > 0, np.arccos(np.clip(least, -1, 1)), np.pi)[:, None]
        at = np.arccos(np.clip(np.take_along_axis(self.unit, self.focus, 1), -1, 1))
        return live, np.cos(np.minimum(np.pi, at + turn)) - 1e-9, np.cos(np.maximum(0, at - turn)) + 1e-9

    def scan(self, bucket: Bucket) -> None:
        n, dim = bucket.vectors.shape
        live, lows, highs = self.ranges(bucket)
        begin, end = np.zeros(self.focus.shape, np.int64), np.full(self.focus.shape, n)
        for f in np.unique(self.focus[live]) if live.any() else ():
            if f < dim:
                values = bucket.unit[bucket.orders[f], f]
                at = (self.focus == f) & live[:, None]
                begin[at], end[at] = np.searchsorted(values, lows[at], "left"), np.searchsorted(values, highs[at], "right")
        size = np.maximum(0, end - begin)
        short = np.argmin(size, axis=1) if size.shape[1] else np.zeros(len(live), np.int64)
        few = live & ((size.min(1) if size.shape[1] else np.full(len(live), n)) * 2 <= n)
        found = []
        if (dense := np.flatnonzero(live & ~few)).size:
            found.append(self.matches(bucket, dense, None))
        for i in np.flatnonzero(few):
            f = self.focus[i, short[i]]
            rows = bucket.orders[f, begin[i, short[i]] : end[i, short[i]]].astype(np.int64)
            for c, g in enumerate(self.focus[i]):
                if c != short[i] and g < dim:
                    v = bucket.unit[rows, g]
                    rows = rows[(v >= lows[i, c]) & (v <= highs[i, c])]
            if rows.size:
                found.append(self.matches(bucket, np.array([i]), rows))
        if found:
            self.keep(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def matches(self, bucket: Bucket, who: np.ndarray, rows: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots, scores and ids of the rows (None: all) that beat the bounds of the anchors ``who``; scores are exact."""
        d = min(bucket.vectors.shape[1], self.vectors.shape[1])
        if self.most * bucket.most * max(d, 1) < 1 << 53:
            mine, theirs, kind = self.real, bucket.real, np.float64
        else:
            mine, theirs, kind = self.vectors, bucket.vectors, np.int64
        theirs, ids, labels = (x if rows is None else x[rows] for x in (theirs, bucket.ids, bucket.labels))
        scores = (mine[who, :d].astype(kind) @ theirs[:, :d].T.astype(kind)).astype(np.int64)
        ok = (self.labels[who][:, None] == labels) == self.same
        for i in np.flatnonzero((self.bucket[who] == bucket.number) & (self.pos[who] < len(bucket.ids))):  # an anchor's own row
            ok[i, self.pos[who[i]] if rows is None else rows == self.pos[who[i]]] = False
        out = []
        for slot in range(self.low.shape[1]):
            low, high = self.low[who, slot][:, None], self.high[who, slot][:, None]
            a, b = np.nonzero(ok & (scores >= low) & (scores <= high))
            s, i = scores[a, b], ids[b]
            better = (s > low[a, 0]) | (i < self.last_id[who[a], slot])
            out.append((who[a[better]] * self.low.shape[1] + slot, s[better], i[better]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def keep(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge new hits and raise the bounds of slots that are full."""
        slots, scores, ids = (np.concatenate(x) for x in zip(self.hits, (slots, scores, ids), strict=True))
        order = np.lexsort((ids, -scores, slots))
        slots, scores, ids = slots[order], scores[order], ids[order]
        rank = np.arange(len(slots)) - np.searchsorted(slots, slots, "left")
        stays = rank < self.best
        self.hits = [slots[stays], scores[stays], ids[stays]]
        last = rank == self.best - 1
        np.put(self.low, slots[last], scores[last])
        np.put(self.last_id, slots[last], ids[last])


def _searcher(slots: int, same: bool, best: int, low_pct: int, high_pct: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The task: a group of buckets against a group of anchors, by slabs of anchors and buckets of falling length."""

    def bounds(anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        if same:
            return np.full((anchors.num_rows, 1), FAR.min), np.full((anchors.num_rows, 1), FAR.max)
        low, high = np.full((anchors.num_rows, slots), 1), np.zeros((anchors.num_rows, slots), np.int64)
        for i, scores in enumerate(anchors["scores"].to_pylist()):
            for j, p in enumerate(scores):
                low[i, j], high[i, j] = -(-low_pct * p // 100), high_pct * p // 100
        return low, high

    def run(buckets: pa.Table, anchors: pa.Table) -> pa.Table:
        if not buckets.num_rows or not anchors.num_rows:
            return _schema(_FOUND).empty_table()
        vecs = [np.frombuffer(v, np.int32) for v in anchors["vec"].to_pylist()]
        vectors = _matrix(vecs, max(map(len, vecs)))
        at, pos, ids, labels = (anchors[c].to_numpy() for c in ("a_bucket", "a_pos", "anchor_id", "label"))
        low, high = bounds(anchors)
        seed = Bucket.of(ids[:SEED], labels[:SEED], vectors[:SEED])
        held = [Bucket(r).open() for r in buckets.to_pylist()]
        held.sort(key=lambda b: b.number)
        out = []
        for i in range(0, len(ids), SLAB):
            part = slice(i, i + SLAB)
            search = Search(at[part], pos[part], labels[part], vectors[part], low[part], high[part], same, best)
            search.seed(seed, np.arange(i, min(i + SLAB, len(ids))))
            for b in held:
                search.scan(b)
            slot, score, found = search.hits
            mine = slot // search.low.shape[1] + i
            out.append(pa.table([at[mine], pos[mine].astype(np.int32), (slot % search.low.shape[1]).astype(np.int32), score, found], schema=_schema(_FOUND)))
        return pa.concat_tables(out)

    return run


def _meet(index: DataFrame, anchors: DataFrame, n_buckets: int, n_anchors: int, search: Callable) -> DataFrame:
    """Every group of anchors with every group of buckets; the best rows of each anchor in each group of buckets."""
    cores = index.sparkSession.sparkContext.defaultParallelism
    groups = max(min(n_buckets, cores), -(-n_buckets // TASK_BUCKETS))
    blocks = -(-n_anchors // GROUP)
    left = index.withColumn("s", F.pmod(F.xxhash64("bucket"), F.lit(groups))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("j", F.pmod(F.xxhash64("a_bucket", "a_pos"), F.lit(blocks)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return left.groupBy("j", "s").cogroup(right.groupBy("j", "s")).applyInArrow(search, _FOUND)


def mine(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, low_pct: int = 30, high_pct: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` over ``vectors(vec_id, embedding, label)``.

    Anchors are the rows whose id is divisible by ``every``; the positives of one are its best ``n_positives`` other rows of the same label, and
    for each the best ``n_negatives`` rows of other labels with a score between ``low_pct`` and ``high_pct`` per cent of the positive's are returned.

    Rows with a null id, label, vector or component, or with a component that is not finite, take no part. Components beyond +-2^25 after scaling count
    as that. A vector shorter than another is led on with zeros. A repeated row is a row of its own: a copy of an anchor is its best positive, and copies of an
    anchor are anchors too. Ties go to the smaller id. A positive with a negative score has no negatives, since its range is empty. An empty table
    gives no rows; columns beyond the three are not read.
    """
    rows = clean_rows(vectors)
    index = build_index(rows)
    n_buckets = index.count()
    anchors = materialize(index.mapInArrow(_anchor_rows(every), "a_bucket long, a_pos int, anchor_id long, label long, vec binary"), "negatives-anchors")
    n_anchors = anchors.count()
    key = ["a_bucket", "a_pos"]
    best = lambda *also: F.row_number().over(Window.partitionBy(*key, *also).orderBy(F.desc("score"), "id"))
    none = anchors.sparkSession.createDataFrame([], _FOUND)
    found = _meet(index, anchors, n_buckets, n_anchors, _searcher(1, True, n_positives, low_pct, high_pct)) if n_anchors else none
    positives = found.withColumn("r", best()).where(F.col("r") <= n_positives)
    positives = materialize(positives.select(*key, (F.col("r") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    listed = positives.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    asked = anchors.join(listed, key)
    found = _meet(index, asked, n_buckets, n_anchors, _searcher(n_positives, False, n_negatives, low_pct, high_pct)) if n_anchors else none
    ranked = found.withColumn("rank", best("slot")).where(F.col("rank") <= n_negatives)
    named = ranked.join(positives, [*key, "slot"]).join(anchors.select(*key, "anchor_id"), key)
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def turned_labels() -> Column:
    """The query's labels: (label + 1) % 10 where the id is divisible by 7."""
    label = F.col("label").cast("long")
    return F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)

"""MinHash near-dedup with min-max hashing.

Each of ``PERMUTATIONS`` hash functions gives two signature values, its minimum and its maximum over the document's shingles, so a
signature of 2 x PERMUTATIONS values costs half the hash evaluations; both are unbiased for the Jaccard similarity and
together vary less. ``ROWS`` values of different permutations, all minima or all maxima, make a band: two documents at similarity 0.75 share none of the
32 bands with probability (1 - 0.75^4)^32 = 5e-6; in small sets, where a permutation's minimum and maximum depend on each other, with less (1.4e-6 at 3 of 4).

Documents with equal word sequences are one node, named by 128 bits of their SHA-256. Within a bucket (one band's value) documents whose signatures
agree in at least ``LEAST_AGREEMENT`` of the values are joined into candidate families, only a spanning star of each leaving the task;
0.55 is more than five standard deviations below what a pair at 0.75 shows. Inside a family links are confirmed on the full shingle sets,
by matrix products, and again only spanning stars leave the task.

A group of more than a block is first compared with its leader, its least node, in one linear pass dealt over tasks. Whoever agrees with the leader
is in its component, so pairs of two such need no comparison; the others are compared with all of the group, block by block. No group meets
in one task and no candidate is dropped. What is quadratic is the number of a group's members that do not agree with its leader, times the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, row_key, sealed, small_batches, split_by_keys
from .words import ASCII_LOWER, gram_hashes, hash_batches, hash_words

SHINGLE, PERCENT = 5, 75
PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
LEAST_AGREEMENT = 0.55
#: Documents of a block of a bucket, and of a family, and the shingles of a block, which bound a task's memory.
BUCKET_BLOCK, FAMILY_BLOCK, BLOCK_SHINGLES = 1024, 384, 1 << 22

_rng = np.random.default_rng(1_234_577)
_A = _rng.integers(1, 1 << 63, size=PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 1 << 63, size=PERMUTATIONS, dtype=np.uint64)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; fewer words are one shingle, none give none."""
    return np.unique(gram_hashes(words, min(SHINGLE, len(words)))) if len(words) else words


def min_max(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures, one row a set: minimum and maximum of every permutation (the top 32 bits)."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), PERMUTATIONS, 2), np.uint32)
    work = np.empty_like(flat)
    for j in range(PERMUTATIONS):
        np.multiply(flat, _A[j], out=work)
        np.add(work, _B[j], out=work)
        out[:, j, 0] = np.minimum.reduceat(work, starts) >> np.uint64(32)
        out[:, j, 1] = np.maximum.reduceat(work, starts) >> np.uint64(32)
    return out.reshape(len(sets), 2 * PERMUTATIONS)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band."""
    parts = signatures.reshape(-1, PERMUTATIONS, 2).transpose(0, 2, 1).reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = (key ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


_SIGNED = "k1 long, k2 long, node binary, n_shingles long, bands array<long>, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        texts = [(t or b"").translate(ASCII_LOWER) for t in batch.column("text").to_pylist()]
        for first, last, words, offsets in hash_batches(texts):
            sets = [shingle_set(words[offsets[i] : offsets[i + 1]]) for i in range(last - first)]
            full = [s for s in sets if len(s)]
            signatures = min_max(full) if full else np.empty((0, 2 * PERMUTATIONS), np.uint32)
            keys, small = band_keys(signatures).tolist(), (signatures & np.uint32(255)).astype(np.uint8)
            digests, bands, sigs, at = [], [], [], 0
            for i, s in enumerate(sets):
                digests.append(hashlib.sha256(b" ".join(texts[first + i].split())).digest()[:16])
                bands.append(keys[at] if len(s) else None)
                sigs.append(small[at].tobytes() if len(s) else None)
                at += bool(len(s))
            part = batch.slice(first, last - first)
            yield pa.record_batch(
                [part.column("k1"), part.column("k2"), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["k1", "k2", "node", "n_shingles", "bands", "sig"],
            )


class Groups:
    """The groups of one task's rows: a label each, the least row of its group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        """Row ``i`` and all rows ``others`` become one group."""
        old = np.unique(np.append(self.label[others], self.label[i]))
        if len(old) > 1:
            self.label[np.isin(self.label, old)] = old[0]

    def stars(self, names: list) -> list[tuple]:
        return [(names[r], names[i]) for i, r in enumerate(self.label.tolist()) if r != i]


def bucket_groups(signatures: np.ndarray, asked: np.ndarray) -> Groups:
    """Groups of a bucket's documents whose signatures agree; pairs without a row that is ``asked`` need not be compared."""
    groups, least = Groups(len(signatures)), LEAST_AGREEMENT * signatures.shape[1]
    for i in np.flatnonzero(asked).tolist():
        apart = np.flatnonzero(groups.label != groups.label[i])
        if len(apart):
            groups.join(i, apart[(signatures[apart] == signatures[i]).sum(axis=1) >= least])
    return groups


def family_groups(sets: list[np.ndarray], asked: np.ndarray) -> Groups:
    """Groups of the sets with 100 * intersection >= 75 * union, over all pairs with a row that is ``asked``."""
    groups, sizes = Groups(len(sets)), np.array([len(s) for s in sets])
    rows = np.flatnonzero(asked)
    if len(sets) < 6:
        for i in rows.tolist():
            for j in range(len(sets)):
                if groups.label[i] != groups.label[j] and min(sizes[i], sizes[j]) * 100 >= PERCENT * max(sizes[i], sizes[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= PERCENT * (sizes[i] + sizes[j] - both):
                        groups.join(i, np.array([j]))
        return groups
    shingles, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = np.bincount(ids, minlength=len(shingles))
    order = np.argsort(ids, kind="stable")
    # shingles of one document add nothing; the others are taken in slices that bound the matrix
    ids, owner = ids[order], owner[order]
    keep = common[ids] > 1
    ids, owner = ids[keep], owner[keep]
    column = np.cumsum(np.concatenate(([0], np.diff(ids) > 0))) if len(ids) else ids
    both = np.zeros((len(rows), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        a, b = np.searchsorted(column, (low, low + 8192))
        part = np.zeros((len(sets), min(8192, int(column[-1]) + 1 - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        both += part[rows] @ part.T
    linked = 100 * both >= PERCENT * (sizes[rows][:, None] + sizes[None, :] - both)
    for n, i in enumerate(rows.tolist()):
        groups.join(i, np.flatnonzero(linked[n]))
    return groups


def _signature(sig: bytes) -> np.ndarray:
    return np.frombuffer(sig, np.uint8)


def _set(text: bytes | None) -> np.ndarray:
    return shingle_set(hash_words((text or b"").translate(ASCII_LOWER)))


def _agree(a: np.ndarray, b: np.ndarray) -> bool:
    return (a == b).sum() >= LEAST_AGREEMENT * len(a)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _edges(found: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _within(read: Callable, groups_of: Callable) -> Callable:
    """Sorted rows (group, bi, bj, node, payload, asked), a block pair's rows together, to the spanning stars of its groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], set()

        def stars() -> list[tuple]:
            if len(held) < 2:
                return []
            values = [read(p) for _, p, _ in held]
            values = np.stack(values) if read is _signature else values
            return groups_of(values, np.array([a for *_, a in held], bool)).stars([n for n, *_ in held])

        for batch in small_batches(batches):
            columns = [batch.column(c).to_pylist() for c in ("key", "bi", "bj", "node", "payload", "asked")]
            for key, bi, bj, node, payload, asked in zip(*columns, strict=True):
                if (key, bi, bj) != now:
                    found.update(stars())
                    now, held = (key, bi, bj), []
                held.append((node, payload, asked))
            if len(found) > 20_000:
                yield _edges(list(found))
                found = set()
        found.update(stars())
        yield _edges(list(found))

    return run


def _with_leader(read: Callable, agrees: Callable) -> Callable:
    """Sorted rows (key, block, follows, node, payload), a block's leader first, to (key, a, b, agrees): each of the others against the leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in small_batches(batches):
            out = []
            for key, follows, node, payload in zip(*(batch.column(c).to_pylist() for c in ("key", "follows", "node", "payload")), strict=True):
                if not follows:
                    leader, own = node, read(payload)
                else:
                    out.append((key, leader, node, bool(agrees(own, read(payload)))))
            names = ["key", "a", "b", "agrees"]
            yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.binary(), pa.bool_()))], names=names)

    return run


def _stars(rows: DataFrame, block: int, read: Callable, groups_of: Callable, agrees: Callable, label: str) -> DataFrame:
    """Edges ``a, b`` that span the groups of each key's rows. ``rows``: key, n and load (rows and shingles of the key), leader, node, payload."""
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("load") / BLOCK_SHINGLES)).cast("int")
    rows = rows.withColumn("blocks", blocks)
    in_one = rows.where("blocks <= 1").select("key", F.lit(0).alias("bi"), F.lit(0).alias("bj"), "node", "payload", F.lit(True).alias("asked"))
    deal = lambda df: df.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(_within(read, groups_of), "a binary, b binary")
    edges = deal(in_one)
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return edges
    large = materialize(large, f"{label}-large")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = large.withColumn("block", F.explode(F.when(F.col("node") == F.col("leader"), every).otherwise(F.array(mine)))).withColumn("follows", F.col("node") != F.col("leader"))
    dealt = dealt.select("key", "block", "follows", "node", "payload").repartition("key", "block").sortWithinPartitions("key", "block", "follows")
    led = materialize(dealt.mapInArrow(_with_leader(read, agrees), "key binary, a binary, b binary, agrees boolean"), f"{label}-led")
    edges = edges.union(led.where("agrees").select("a", "b"))
    apart = led.where("NOT agrees").select("key", F.col("b").alias("node"))
    if apart.isEmpty():
        return edges
    # the others against all: both sides in blocks, and every pair of blocks
    counts = materialize(apart.groupBy("key").agg(F.count(F.lit(1)).alias("m")), f"{label}-apart")
    open_ = large.join(counts, "key").withColumn("parts", F.ceil(F.greatest(F.col("m") / block, F.col("load") / F.col("n") * F.col("m") / BLOCK_SHINGLES)).cast("int"))
    ask = open_.join(apart, ["key", "node"], "left_semi").select("key", F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int").alias("bi"), F.explode(every).alias("bj"), "node", "payload", F.lit(True).alias("asked"))
    told = open_.join(apart, ["key", "node"], "left_anti").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("bi"), mine.alias("bj"), "node", "payload", F.lit(False).alias("asked"))
    among = open_.join(apart, ["key", "node"], "left_semi").withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct((-1 - F.least(F.col("own"), o)).alias("bi"), (-1 - F.greatest(F.col("own"), o)).alias("bj")))
    among = among.withColumn("p", F.explode(pairs)).select("key", "p.bi", "p.bj", "node", "payload", F.lit(True).alias("asked"))
    return edges.union(deal(ask.union(told).union(among)))


def components(docs: DataFrame) -> DataFrame:
    """``k1, k2, n_shingles, node, root``: the node of each document and the least node reachable by links."""
    keyed = docs.select(*row_key(), F.col("text").cast("binary").alias("text"))
    signed = materialize(keyed.mapInArrow(_sign, _SIGNED), "neardup-signed")
    # one row a node, so that a group of copies has one set of entries; plain inputs let Spark split hot buckets
    nodes = signed.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("own"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = materialize(nodes, "neardup-nodes")
    entries = nodes.select("node", F.explode_outer("bands").alias("bucket"))
    shared = materialize(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1"), "neardup-shared")
    crowded = entries.join(shared, "bucket").join(nodes.select("node", F.col("sig").alias("payload")), "node")
    crowded = crowded.select(F.unhex(F.hex("bucket")).alias("key"), "n", F.lit(0).alias("load"), "leader", "node", "payload")
    stars = _stars(materialize(crowded, "neardup-crowded"), BUCKET_BLOCK, _signature, bucket_groups, _agree, "neardup-buckets")
    families = materialize(connected_components(stars, "neardup-families").select("node", F.col("root").alias("key")), "neardup-members")
    members = families.join(nodes.select("node", "n_shingles", "own"), "node")
    sizes = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("load")), "neardup-sizes")
    members = materialize(members.select("key", "node", "own.k1", "own.k2"), "neardup-owners")
    texts = split_by_keys(keyed, members.select("k2"))[0].join(members, ["k1", "k2"]).dropDuplicates(["key", "node"]).join(sizes, "key")
    texts = materialize(texts.select("key", "n", "load", F.col("key").alias("leader"), "node", F.col("text").alias("payload")), "neardup-texts")
    links = _stars(texts, FAMILY_BLOCK, _set, family_groups, _linked, "neardup-texts")
    roots = connected_components(links, "neardup-links")
    return signed.select("k1", "k2", "n_shingles", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Null texts and texts without words have an empty set, link with nothing and are kept. Repeated rows and equal texts
    form one component; if its least doc_id is repeated, each such row is kept. A row without doc_id takes the least doc_id of its component,
    and is kept only if there is none.
    """
    found = components(docs).dropDuplicates(["k1", "k2"])
    own = docs.select("doc_id", *row_key())
    rows = own.join(found, ["k1", "k2"], "left")
    least = materialize(rows.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "neardup-least")
    out = rows.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the least (doc_id, text hash); documents without words all stay."""
    found = components(docs).where("n_shingles > 0").select("k1", "k2", "root")
    first = found.groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "m")
    touched = materialize(found.join(first, "root").select("k1", "k2", (F.col("m") == F.struct("k1", "k2")).alias("stays")).distinct(), "neardup-touched")
    inner, back = sealed(docs)
    some, rest = split_by_keys(inner.select("*", *row_key()), touched.select("k2"))
    marked = some.join(touched, ["k1", "k2"], "left")
    one_each = marked.where("stays").dropDuplicates(["k1", "k2"])
    return marked.where("stays IS NULL").union(one_each).select(*back).union(rest.select(*back))

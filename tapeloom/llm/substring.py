"""Substring dedup by super-k-mers.

A window is ``k`` consecutive words. Its minimiser is the leftmost of its ``m``-word grams of least hash; consecutive windows with
one minimiser occurrence form a super-k-mer and travel as one packed string to the minimiser's bucket, where sorting
counts their windows exactly.

Windows with equal words have equal minimisers, so only minimisers with two or more super-k-mers matter: a first pass counts them
(8 bytes each, combined before the shuffle) and the packed strings of all others never travel. Equal packed strings
are counted before the bucket sees them, so a group of copies is one string. In a bucket with very many different strings
Spark counts single windows by 128 bits of their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, sealed, split_by_keys
from .words import gram_hashes, hash_batches

K, M = 35, 8
#: The windows of a bucket with more different strings than this are counted by Spark and not in one task.
BUCKET_STRINGS = 2000


def _leftmost_minima(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the position of its leftmost minimum."""
    val, at, have = g, np.arange(len(g)), 1
    while have < width:
        shift = min(have, width - have)
        n = len(val) - shift
        later = val[shift:] < val[:n]
        at = np.where(later, at[shift:], at[:n])
        val = np.minimum(val[shift:], val[:n])
        have += shift
    return at


def super_kmers(words: np.ndarray, offsets: np.ndarray, k: int = K, m: int = M) -> tuple[np.ndarray, ...]:
    """``(text, start, windows, minimiser)`` arrays for the texts of a batch; start counts words from the text's own first."""
    if len(words) < k:
        return (np.empty(0, np.int64),) * 4
    grams = gram_hashes(words, m)
    at = _leftmost_minima(grams, k - m + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    valid = np.arange(len(at)) + k <= offsets[text + 1]
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new & valid)
    runs = np.cumsum(new)
    counts = np.bincount(runs, weights=valid).astype(np.int64)[runs[starts]]
    return text[starts], starts - offsets[text[starts]], counts, grams[at[starts]].astype(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (k1, k2, text) to their super-k-mers (h, k1, k2, start, n)."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for first, last, words, offsets in hash_batches(texts):
            text, start, n, h = super_kmers(words, offsets)
            part = batch.slice(first, last - first)
            keys = [part.column(c).take(pa.array(text)) for c in ("k1", "k2")]
            yield pa.record_batch([pa.array(h), *keys, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["h", "k1", "k2", "start", "n"])


def _digest(packed: bytes) -> bytes:
    return hashlib.sha256(packed).digest()[:16]


def _pack(with_strings: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with ``at`` (start * 64 + n, h) to the packed strings there, or to their digests and places."""
        for batch in batches:
            rows: list[list] = [[] for _ in range(4)]
            for i in range(batch.num_rows):
                at = batch.column("at")[i].as_py()
                if not at:
                    continue
                words = batch.column("text")[i].as_py().split()
                k1, k2 = batch.column("k1")[i].as_py(), batch.column("k2")[i].as_py()
                for x in at:
                    start, n = divmod(x["at"], 64)
                    packed = b" ".join(words[start : start + n + K - 1])
                    for column, value in zip(rows, (x["h"], packed) if with_strings else (x["h"], _digest(packed), (k1, k2), start), strict=False):
                        column.append(value)
                if len(rows[0]) > 50_000:
                    yield _packed_batch(rows, with_strings)
                    rows = [[] for _ in range(4)]
            yield _packed_batch(rows, with_strings)

    return run


def _packed_batch(rows: list[list], with_strings: bool) -> pa.RecordBatch:
    if with_strings:
        return pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary())], names=["h", "packed"])
    keys = [pa.array([k[j] for k in rows[2]], pa.int64()) for j in (0, 1)]
    return pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), *keys, pa.array(rows[3], pa.int32())], names=["h", "dig", "k1", "k2", "start"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings (h, packed, cnt) to their single windows, by digest: (h, win, dig, shift, cnt)."""
    schema = pa.schema([("h", pa.int64()), ("win", pa.binary()), ("dig", pa.binary()), ("shift", pa.int32()), ("cnt", pa.int64())])
    for batch in batches:
        out: list[tuple] = []
        for h, packed, cnt in zip(*(batch.column(c).to_pylist() for c in ("h", "packed", "cnt")), strict=True):
            dig, words = _digest(packed), packed.split(b" ")
            out += [(h, _digest(b" ".join(words[i : i + K])), dig, i, cnt) for i in range(len(words) - K + 1)]
            if len(out) > 50_000:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], schema=schema)


def repeated_windows(strings: list[tuple[bytes, int]]) -> list[int]:
    """For each packed string of a bucket with its number of copies, the mask of its windows that occur twice or more."""
    if len(strings) == 1:
        packed, copies = strings[0]
        return [(1 << (packed.count(b" ") - K + 2)) - 1 if copies > 1 else 0]
    windows = []
    for s, (packed, copies) in enumerate(strings):
        words = packed.split(b" ")
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        start = 0
        for i in range(len(words) - K + 1):
            windows.append((packed[start : ends[i + K - 1] - 1], copies, s, i))
            start = ends[i]
    windows.sort()
    masks = [0] * len(strings)
    at = 0
    while at < len(windows):
        end, copies = at, 0
        while end < len(windows) and windows[end][0] == windows[at][0]:
            copies += windows[end][1]
            end += 1
        if copies > 1:
            for _, _, s, i in windows[at:end]:
                masks[s] |= 1 << i
        at = end
    return masks


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, packed, cnt) sorted by h, a bucket's rows together, to (h, dig, mask) of strings with repeated windows."""
    bucket, held = None, []
    schema = pa.schema([("h", pa.int64()), ("dig", pa.binary()), ("mask", pa.int64())])
    for batch in batches:
        out: list[tuple] = []
        for h, packed, cnt in zip(*(batch.column(c).to_pylist() for c in ("h", "packed", "cnt")), strict=True):
            if bucket != h:
                out += _bucket_rows(bucket, held)
                bucket, held = h, []
            held.append((packed, cnt))
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], schema=schema)
    if out := _bucket_rows(bucket, held):
        yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], schema=schema)


def _bucket_rows(bucket: int | None, held: list[tuple[bytes, int]]) -> list[tuple]:
    if not held or (len(held) == 1 and held[0][1] == 1):
        return []
    return [(bucket, _digest(packed), mask) for (packed, _), mask in zip(held, repeated_windows(held), strict=True) if mask]


def _crowded_masks(strings: DataFrame) -> DataFrame:
    """``h, dig, mask`` of strings in crowded buckets: Spark counts the windows, combined before the shuffle, and no task holds a group."""
    windows = materialize(strings.mapInArrow(_windows, "h long, win binary, dig binary, shift int, cnt long"), "substring-windows")
    repeated = materialize(windows.groupBy("h", "win").agg(F.sum("cnt").alias("c")).where("c > 1").select("h", "win"), "substring-repeated")
    return windows.join(repeated, ["h", "win"]).select("h", "dig", F.expr("shiftleft(1L, shift)").alias("mask"))


def find_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that may hold repeats, ``k1, k2, text``, and ``k1, k2, runs array<struct<start, mask>>``.

    Bit i of mask stands for a window at word start + i whose words also start elsewhere. Documents without such windows have no
    row in the second table. What a skewed join reads is written first: Spark splits the hot partitions of plain inputs only.
    """
    keyed = docs.select(*row_key(), F.col("text").cast("binary").alias("text"))
    kmers = keyed.mapInArrow(_scan, "h long, k1 long, k2 long, start int, n int").withColumn("at", F.col("start").cast("long") * 64 + F.col("n"))
    shared = materialize(kmers.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "substring-shared")
    at = kmers.select("h", "k1", "k2", "at").join(shared, "h", "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "h")).alias("at"))
    at = materialize(at, "substring-at")
    some = materialize(split_by_keys(keyed, at.select("k2"))[0].join(at, ["k1", "k2"]), "substring-texts")
    strings = some.mapInArrow(_pack(True), "h long, packed binary")
    distinct = materialize(strings.groupBy("h", "packed").agg(F.count(F.lit(1)).alias("cnt")), "substring-strings")
    crowded = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > BUCKET_STRINGS)
    crowded = materialize(crowded.select("h"), "substring-crowded")
    whole = distinct.join(crowded, "h", "left_anti").select("h", "packed", "cnt")
    counted = whole.repartition("h").sortWithinPartitions("h").mapInArrow(_count_buckets, "h long, dig binary, mask long")
    counted = counted.union(_crowded_masks(distinct.join(crowded, "h", "left_semi").select("h", "packed", "cnt")))
    masks = materialize(counted.groupBy("h", "dig").agg(F.bit_or("mask").alias("mask")), "substring-masks")
    places = some.mapInArrow(_pack(False), "h long, dig binary, k1 long, k2 long, start int")
    runs = places.join(masks, ["h", "dig"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "mask")).alias("runs"))
    return some.select("k1", "k2", "text"), runs


def kept_words(text: bytes, runs: list[dict] | None) -> tuple[list[bytes], int]:
    """The words outside the repeated windows, and how many words there were."""
    words = text.split()
    if not runs:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        mask, at = run["mask"], run["start"]
        while mask:
            if mask & 1:
                edge[at] += 1
                edge[at + K] -= 1
            mask, at = mask >> 1, at + 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], len(words)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with text, and runs if there are any, to their other columns with the counts and the digest of what stays."""
    for batch in batches:
        out = []
        runs = batch.column("runs").to_pylist() if "runs" in batch.schema.names else [None] * batch.num_rows
        for text, own in zip(batch.column("text"), runs, strict=True):
            kept, n = kept_words(text.as_py() or b"", own)
            out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, removed, sha = zip(*out, strict=True) if out else ((), (), ())
        rest = [c for c in batch.schema.names if c not in ("text", "runs")]
        yield pa.record_batch([*[batch.column(c) for c in rest], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=[*rest, "n_words", "n_removed", "kept_sha256"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
            text, runs = text.as_py(), runs.as_py()
            texts.append(text if text is None or not runs else b" ".join(kept_words(text, runs)[0]))
        yield batch.drop_columns(["text", "runs"]).append_column("text", pa.array(texts, pa.binary()))


def substring_summary(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document after removal of repeated windows.

    Windows are judged on the input. Null text has no words; texts under 35 words have no window. A row that occurs
    twice, or a null or repeated doc_id, is a document of its own.
    """
    some, runs = find_repeats(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    figures = "n_words long, n_removed long, kept_sha256 string"
    changed = some.join(runs, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).mapInArrow(_summary, f"k1 long, k2 long, {figures}")
    changed = changed.select("k1", "k2", F.col("n_removed").alias("cut"), F.col("kept_sha256").alias("sha"))
    every = docs.select("doc_id", *row_key(), F.col("text").cast("binary").alias("text")).mapInArrow(_summary, f"doc_id {kind}, k1 long, k2 long, {figures}")
    joined = every.join(changed, ["k1", "k2"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("cut", "n_removed").alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"))


def drop_substrings(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated windows' words cut from the texts; texts that lose words are joined by single spaces."""
    inner, back = sealed(docs)
    runs = materialize(find_repeats(docs)[1], "substring-runs")
    some, rest = split_by_keys(inner.select("*", *row_key()), runs.select("k2"))
    joined = some.join(runs, ["k1", "k2"], "left").select("doc_id", "_rest", F.col("text").cast("binary").alias("text"), "runs")
    fields = ", ".join(f"{c} {inner.schema[c].dataType.simpleString()}" for c in ("doc_id", "_rest"))
    out = joined.mapInArrow(_rewrite, f"{fields}, text binary").withColumn("text", F.col("text").cast("string"))
    return out.select(*back).union(rest.select(*back))

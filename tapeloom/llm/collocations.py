"""Phrase collocation mining: frequent phrases of two to four words, scored by their weakest cut.

Frequent words are numbered by falling frequency and texts become streams of numbers, a table that every level reads. A level counts pairs of
neighbouring numbers, as a matrix in tiles: tiles of the head, which the most frequent numbers share, are direct-address tables counted with
``bincount`` where they are dense; all other pairs are counted as sorted coordinates. Spark adds the counts up. Frequent pairs are numbered
by frequency in turn, and paired with the next word for the level above: a phrase of k + 1 words can be frequent only if both phrases of k words in it are.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, numbered

#: Bytes of text split, and numbers written in a row, at once.
CHUNK_BYTES, CHUNK = 1 << 20, 1 << 18
#: Distinct words that a task counts before it hands them on, and bytes of texts or streams handed to a task at once.
DISTINCT, BATCH_BYTES = 1 << 17, 8 << 20
#: Words sent to every task: so many of the most frequent, of at most so many bytes each. Others are joined.
HEAD_WORDS, HEAD_BYTES = 1 << 19, 64
#: Frequent phrases sent to every task at once; more take more passes over the numbers.
SLICE = 1 << 21
#: Side of a tile, tiles a side of the head, and pairs that make a tile dense.
TILE, HEAD_TILES, DENSE = 256, 64, 256 * 256 // 8
#: Words of the longest phrase.
LONGEST = 4

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _SEPARATORS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(_SEPARATORS) + b" ")
_WORDS = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
_STREAM = pa.schema([("own", pa.int32()), ("ids", pa.binary()), ("gram", pa.binary())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def text_slices(text: bytes) -> Iterator[bytes]:
    """The text with its letters and separators made plain (``\\n`` between pieces, space between words), cut between words."""
    at = 0
    while at < len(text):
        end = at + CHUNK_BYTES
        piece = text[at:end].translate(_LOWER)
        while end < len(text):
            cut = max(piece.rfind(b" "), piece.rfind(b"\n")) + 1
            if cut:
                piece = piece[:cut]
                break
            piece += text[end : end + CHUNK_BYTES].translate(_LOWER)
            end += CHUNK_BYTES
        yield piece
        at += len(piece)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to counts of words; a row without a word has the number of all words of a language."""
    counts: dict[str, Counter] = {}
    totals: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        rows = [(lang, word, n) for lang, c in counts.items() for word, n in c.items()] + [(lang, None, n) for lang, n in totals.items()]
        counts.clear()
        totals.clear()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _WORDS, strict=True)], schema=_WORDS)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for piece in text_slices(text.as_py() or b""):
                words = piece.split()
                counts.setdefault(lang, Counter()).update(words)
                totals[lang] += len(words)
                if sum(map(len, counts.values())) > DISTINCT:
                    yield flushed()
    if totals:
        yield flushed()


class _Numbers(dict):
    """Word to number; -1 where there is none."""

    def __missing__(self, word: bytes) -> int:
        return -1


_made: dict[str, dict] = {}


def _by_language(key: str, head: pa.Table) -> dict[str, _Numbers]:
    """The head's numbers by language, made once in a process."""
    if key not in _made:
        _made.clear()
        out: dict[str, _Numbers] = {}
        for lang, word, number in zip(*(head[c].to_pylist() for c in ("lang", "word", "id")), strict=True):
            out.setdefault(lang, _Numbers({b"": -2, b"\n": -1}))[word] = number
        _made[key] = out
    return _made[key]


def _unknown(head) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (lang, sha, text) to the distinct words of each that the head lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _by_language(*head.value)
        for batch in batches:
            for lang, sha, text in zip(*(batch.column(c) for c in ("lang", "sha", "text")), strict=True):
                own, missing = known.get(lang.as_py(), {}), set()
                for piece in text_slices(text.as_py() or b""):
                    missing.update(w for w in piece.split() if w not in own)
                if missing:
                    yield pa.record_batch([pa.array([lang.as_py()] * len(missing)), pa.array([sha.as_py()] * len(missing)), pa.array(list(missing), pa.binary())], names=["lang", "sha", "word"])

    return run


def _encode(head) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (lang, text, more) to streams of numbers in rows of CHUNK and a few to look ahead; -1 stands between pieces and for words that are not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, length = _by_language(*head.value), [], 0

        def rows(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, length
            stream = np.concatenate(held) if held else np.empty(0, np.int32)
            while len(stream) > least:
                own, part = min(CHUNK, len(stream)), stream[: CHUNK + LONGEST - 1].tobytes()
                yield pa.record_batch([pa.array([own], pa.int32()), pa.array([part]), pa.array([part])], schema=_STREAM)
                stream = stream[own:]
            held, length = [stream], len(stream)

        for batch in batches:
            more = batch.column("more") if "more" in batch.schema.names else [None] * batch.num_rows
            for lang, text, extra in zip(batch.column("lang").to_pylist(), batch.column("text"), more, strict=True):
                own = known.get(lang) or _Numbers({b"": -2, b"\n": -1})
                extra = {x["word"]: x["id"] for x in (extra.as_py() if extra is not None else None) or ()}
                for piece in text_slices(text.as_py() or b""):
                    words = piece.replace(b"\n", b" \n ").split(b" ")
                    if extra:
                        numbers = np.array([own[w] if w in own else extra.get(w, -1) for w in words], np.int32)
                    else:
                        numbers = np.fromiter(map(own.__getitem__, words), np.int32, len(words))
                    numbers = numbers[numbers != -2]
                    held.append(numbers)
                    length += len(numbers)
                    if length > CHUNK + LONGEST:
                        yield from rows(CHUNK + LONGEST)
                held.append(np.array([-1], np.int32))
                length += 1
        yield from rows(0)

    return run


def count_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers and how often each stands there."""
    head = (a < TILE * HEAD_TILES) & (b < TILE * HEAD_TILES)
    x, y = a[head], b[head]
    tile = x // TILE * HEAD_TILES + y // TILE
    sizes = np.bincount(tile, minlength=HEAD_TILES * HEAD_TILES)
    dense = np.flatnonzero(sizes >= DENSE)
    place = np.full(len(sizes), -1)
    place[dense] = np.arange(len(dense))
    inside = place[tile] >= 0
    cells = np.bincount((place[tile[inside]] * TILE + x[inside] % TILE) * TILE + y[inside] % TILE, minlength=len(dense) * TILE * TILE)
    at = np.flatnonzero(cells)
    tiles, rest = dense[at // (TILE * TILE)], at % (TILE * TILE)
    sparse = ~head
    sparse[np.flatnonzero(head)[~inside]] = True
    codes, n = np.unique(a[sparse] << 32 | b[sparse], return_counts=True)
    first = np.concatenate((tiles // HEAD_TILES * TILE + rest // TILE, codes >> 32))
    return first, np.concatenate((tiles % HEAD_TILES * TILE + rest % TILE, codes & 0xFFFFFFFF)), np.concatenate((cells[at], n))


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for own, ids, gram in zip(*(batch.column(c) for c in ("own", "ids", "gram")), strict=True):
        yield own.as_py(), np.frombuffer(ids.as_py(), np.int32), np.frombuffer(gram.as_py(), np.int32)


def _count_level(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (phrase of ``words`` words, next word) of every row whose later ``words`` words are frequent too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, ids, gram in _arrays(batch):
                n = max(0, min(own, len(ids) - words))
                a, b = gram[:n].astype(np.int64), ids[words : words + n].astype(np.int64)
                fine = (a >= 0) & (b >= 0) & (gram[1 : n + 1] >= 0)
                yield pa.record_batch([pa.array(x) for x in count_pairs(a[fine], b[fine])], schema=_PAIRS)

    return run


def _fill(words: int, codes, fresh: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The numbers of the phrases of ``words`` words, by start, as far as ``codes`` has them; ``done`` holds what earlier passes found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = codes.value
        for batch in batches:
            for i, (own, ids, gram) in enumerate(_arrays(batch)):
                made = np.full(len(ids), -1, np.int32) if fresh else np.frombuffer(batch.column("done")[i].as_py(), np.int32).copy()
                n = max(0, len(ids) - words + 1)
                a, b = gram[:n].astype(np.int64), ids[words - 1 : words - 1 + n].astype(np.int64)
                ask = np.flatnonzero((a >= 0) & (b >= 0) & (made[:n] < 0))
                query = a[ask] << 32 | b[ask]
                at = np.minimum(np.searchsorted(known, query), len(known) - 1)
                made[ask] = np.where(known[at] == query, number[at], -1)
                yield pa.record_batch([pa.array([own], pa.int32()), *[pa.array([x.tobytes()]) for x in (ids, gram, made)]], names=["own", "ids", "gram", "done"])

    return run


def by_frequency(counts: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``counts`` with gapless numbers ``id`` from 0, by falling power of two of ``n``; a written table."""
    classed = materialize(counts.withColumn("class", F.floor(F.log2("n")).cast("int")), f"{label}-counts")
    sizes = sorted(((r["class"], r["count"]) for r in classed.groupBy("class").count().collect()), reverse=True)  # at most 64
    before = reduce(lambda c, x: c.when(F.col("class") == x[1][0], F.lit(sum(s for _, s in sizes[: x[0]]))), enumerate(sizes), F.when(F.lit(False), F.lit(0)))
    out = materialize(numbered(classed, ["class"], keys, "r").withColumn("id", (before + F.col("r")).cast("long")).drop("r", "class"), label)
    discard(classed)
    return out


def number_words(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``id, lang, word, n`` of frequent words, and ``lang, n`` of all words."""
    counted = docs.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialize(counted.where(F.col("word").isNull() | (F.col("n") >= least)), "collocations-counted")
    vocabulary = by_frequency(counted.where("word IS NOT NULL"), ["lang", "word"], "collocations-words")
    return vocabulary, counted.where("word IS NULL").select("lang", "n")


def number_texts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The texts as streams of word numbers, a written table. Words of the head are looked up in the tasks, rarer and longer ones are joined by text."""
    in_head = (F.col("id") < HEAD_WORDS) & (F.octet_length("word") <= HEAD_BYTES)
    head = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, vocabulary.where(in_head).select("lang", "word", "id").toArrow()))  # at most HEAD_WORDS * HEAD_BYTES bytes of words
    tail = vocabulary.where(~in_head).select("lang", "word", "id")
    if not tail.isEmpty():
        keyed = docs.withColumn("sha", F.sha2("text", 256))
        met = keyed.where("text IS NOT NULL").mapInArrow(_unknown(head), "lang string, sha string, word binary")
        more = materialize(met.join(tail, ["lang", "word"]).groupBy("lang", "sha").agg(F.collect_set(F.struct("word", "id")).alias("more")), "collocations-tail")
        docs = keyed.join(more, ["lang", "sha"], "left").select("lang", "text", "more")
    return materialize(docs.mapInArrow(_encode(head), "own int, ids binary, gram binary"), "collocations-stream")


def number_phrases(stream: DataFrame, phrases: DataFrame, words: int) -> DataFrame:
    """``stream`` with ``gram`` the numbers of frequent phrases of ``words`` words, in passes of SLICE phrases each; a written table."""
    n, context = phrases.count(), stream.sparkSession.sparkContext
    for at in range(0, max(n, 1), SLICE):
        part = phrases.where((F.col("id") >= at) & (F.col("id") < at + SLICE)).select("a", "b", "id").toArrow()  # at most SLICE rows
        a, b, number = (part[c].to_numpy() for c in ("a", "b", "id"))
        order = np.argsort(a << 32 | b)
        codes = context.broadcast(((a << 32 | b)[order], number[order].astype(np.int32)) if len(a) else (np.array([-1]), np.array([-1], np.int32)))
        filled = materialize(stream.mapInArrow(_fill(words, codes, at == 0), "own int, ids binary, gram binary, done binary"), f"collocations-stream{words}")
        discard(stream)
        stream = filled
    return stream.select("own", "ids", F.col("done").alias("gram"))


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Batches of at most ``size`` bytes for the jobs run inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``ids array<long>, n`` of all frequent phrases of one to LONGEST words, the vocabulary, and the words of each language."""
    vocabulary, totals = number_words(docs, least)
    stream = number_texts(docs, vocabulary)
    named = vocabulary.select("id", F.array("id").alias("ids"), "n")
    levels = [named]
    for words in range(1, LONGEST):
        counted = stream.mapInArrow(_count_level(words), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        phrases = by_frequency(counted, ["a", "b"], f"collocations-{words + 1}")
        before = named.select(F.col("id").alias("a"), F.col("ids").alias("head"))
        named = materialize(phrases.join(before, "a").select("id", F.concat("head", F.array("b")).alias("ids"), "n"), f"collocations-named{words + 1}")
        levels.append(named)
        if words + 1 < LONGEST:
            stream = number_phrases(stream, phrases, words + 1)
    discard(stream)
    return reduce(DataFrame.union, [x.select("ids", "n") for x in levels]), vocabulary, totals


def weakest_cut(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 * a / (left + right)), exact: decimals hold products beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide(a), wide(left) + wide(right)).cast("long")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, cover_pct: int = 80) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language by score, frequency and bytes of the phrase.

    A phrase of two to four words that occurs at least ``least`` times within pieces is a candidate. Its score is that of its weakest cut (ties: the first), and it goes if
    a longer candidate with ``cover_pct`` per cent of its occurrences holds its words.

    Null text is empty, null lang is ``und``, together with rows whose lang is that. Only ASCII letters are lower-cased. Texts of any length, without spaces
    too, are read in slices cut between words. A repeated row counts again. An empty table gives no rows; columns beyond text and lang are not read.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        grams, vocabulary, totals = frequent_phrases(docs, least)
    candidates = grams.where(F.size("ids") > 1)
    cuts = candidates.withColumn("cut", F.explode(F.expr("sequence(1, size(ids) - 1)")))
    cuts = cuts.select("ids", F.col("n").alias("a"), "cut", F.expr("slice(ids, 1, cut)").alias("first"), F.expr("slice(ids, cut + 1, size(ids))").alias("last"))
    cuts = cuts.join(grams.select(F.col("ids").alias("first"), F.col("n").alias("l")), "first").join(grams.select(F.col("ids").alias("last"), F.col("n").alias("r")), "last")
    cuts = cuts.withColumn("score", weakest_cut(F.col("a"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("ids", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("ids", "a", "x.score", "x.l", "x.r")
    inner = "flatten(transform(sequence(2, size(ids) - 1), k -> transform(sequence(1, size(ids) - k + 1), i -> slice(ids, i, k))))"
    longer = candidates.where(F.size("ids") > 2).select(F.explode(F.expr(inner)).alias("ids"), F.col("n").alias("f")).groupBy("ids").agg(F.max("f").alias("f"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = scored.join(longer, "ids", "left").where(F.col("f").isNull() | (wide("f") * 100 < wide("a") * cover_pct)).drop("f")
    kept = materialize(kept.withColumn("key", F.monotonically_increasing_id()), "collocations-kept")
    words = kept.select("key", F.posexplode("ids").alias("at", "id")).join(vocabulary.select("id", "lang", F.col("word").cast("string").alias("word")), "id")
    named = words.groupBy("key", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = kept.join(named, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

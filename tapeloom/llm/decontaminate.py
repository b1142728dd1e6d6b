"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned token windows, verified hits.

Only DataFrame functions run. A window of n item words holds g-grams at n - g + 1 consecutive starts, so one of
them starts at a multiple of that stride in any document. Documents are therefore probed only at multiples of the stride, in one pass for all
window lengths, against the hash set of all g-grams of the item windows; what the probes find is verified on the words
themselves, for which only the documents found (and few others, see ``split_by_keys``) are read again and shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, maybe_broadcast, row_key, sealed, split_by_keys

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does the same, faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def anchor(length: int) -> tuple[int, int]:
    """Gram size and stride for windows of ``length`` words."""
    gram = max(1, length // 2)
    return gram, length - gram + 1


def item_windows(benchmark: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """``item, ids`` (items of equal words are one item) and ``item, len, win`` for each window of each; an item of fewer words is one window."""
    items = benchmark.select("item_id", item_words(F.col("text")).alias("w")).where("size(w) > 0").groupBy("w").agg(F.collect_set("item_id").alias("ids"))
    items = materialize(items.select(F.sha2(F.array_join("w", " ").cast("binary"), 256).alias("item"), "w", "ids"), "decon-items")
    sized = items.select("item", "w", F.least(F.size("w"), F.lit(length)).alias("len"))
    windows = sized.select("item", "len", F.explode(F.expr("transform(sequence(1, size(w) - len + 1), i -> slice(w, i, len))")).alias("win"))
    return items.select("item", "ids"), materialize(windows.distinct(), "decon-windows")


def find_hits(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """``k1, k2, n_hit, mask array<boolean>, items array`` for each document with an occurring window.

    mask tells for each word up to the last hit whether it is hit; it is built in one pass over the sorted windows.
    """
    items, windows = item_windows(benchmark, length)
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most ``length`` values
    keyed = docs.select(*row_key(), "text")
    if not lengths:
        return keyed.where("false").select("k1", "k2", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<boolean>").alias("mask"), F.array().cast("array<string>").alias("items"))
    grams, probes = [], []
    for n in lengths:
        gram, stride = anchor(n)
        grams.append(windows.where(F.col("len") == n).select(F.explode(F.expr(f"transform(sequence(1, {stride}), i -> xxhash64({n}, slice(win, i, {gram})))")).alias("h")))
        probes.append(f"if(size(w) >= {n}, transform(sequence(0, size(w) - {gram}, {stride}), i -> struct({n} AS n, {stride} AS stride, i AS i, xxhash64({n}, slice(w, i + 1, {gram})) AS h)), array())")
    hashes = materialize(reduce(DataFrame.union, grams).distinct(), "decon-grams")
    words = keyed.select("k1", "k2", item_words(F.col("text")).alias("w"))
    # the outer form: a filter inferred for the inner one would tokenise every text a second time
    probed = words.select("k1", "k2", F.explode_outer(F.expr(f"concat({', '.join(probes)})")).alias("p")).select("k1", "k2", "p.*")
    if hashes.count() * 40 > BROADCAST_BYTES:  # a bitmap of the grams leaves few other probes to shuffle
        probed = split_by_keys(probed, hashes, "h")[0]
    found = probed.join(maybe_broadcast(hashes, F.lit(8)), "h")
    at = materialize(found.groupBy("k1", "k2").agg(F.collect_set(F.struct("n", "stride", "i")).alias("at")), "decon-found")
    near = split_by_keys(keyed, at.select("k2"))[0].join(at, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "at", item_words(F.col("text")).alias("w"))
    starts = "transform(sequence(greatest(0, a.i - a.stride + 1), greatest(0, least(a.i, size(w) - a.n))), s -> struct(s, a.n AS len))"
    starts = f"filter(array_distinct(flatten(transform(at, a -> {starts}))), x -> x.s + x.len <= size(w))"
    near = near.select("k1", "k2", F.explode_outer(F.expr(f"transform({starts}, x -> struct(x.s, x.len, array_join(slice(w, x.s + 1, x.len), ' ') AS win))")).alias("x")).select("k1", "k2", "x.s", "x.len", "x.win")
    by_win = materialize(windows.select(F.array_join("win", " ").alias("win"), "item").groupBy("win").agg(F.collect_set("item").alias("of")), "decon-by-win")
    hits = materialize(near.join(maybe_broadcast(by_win, F.octet_length("win") + 80 * F.size("of")), "win").select("k1", "k2", "s", "len", "of"), "decon-hits")
    before = F.max(F.col("s") + F.col("len")).over(Window.partitionBy("k1", "k2").orderBy("s", "len").rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select("k1", "k2", "s", "len").withColumn("upto", F.coalesce(before, F.lit(0)))
    spans = spans.withColumns({"gap": F.greatest(F.lit(0), F.col("s") - F.col("upto")), "fresh": F.greatest(F.lit(0), F.col("s") + F.col("len") - F.greatest("s", "upto"))})
    marks = spans.groupBy("k1", "k2").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_list(F.struct("s", "len", "gap", "fresh"))).alias("marks"))
    mask = F.flatten(F.transform("marks", lambda x: F.concat(F.array_repeat(F.lit(False), x["gap"]), F.array_repeat(F.lit(True), x["fresh"]))))
    of = hits.select("k1", "k2", F.explode("of").alias("item")).distinct().join(items, "item").select("k1", "k2", F.explode_outer("ids").alias("id")).groupBy("k1", "k2").agg(F.collect_set("id").alias("items"))
    return materialize(marks.select("k1", "k2", "n_hit", mask.alias("mask")).join(of, ["k1", "k2"]), "decon-docs")


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every document.

    Null or wordless texts have no words and are clean; so is every document when the benchmark is empty. Items without words
    are no windows. Equal items all count. Repeated rows each get their own result row.
    """
    hits = find_hits(docs, benchmark, length)
    base = docs.select("doc_id", *row_key(), F.size(F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).cast("long").alias("n_words"))
    names = F.expr("array_sort(transform(coalesce(items, array()), x -> cast(x AS string)))")
    return base.join(hits, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), F.col("items").isNotNull().alias("contaminated"),
    )


def remove_contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, whole: bool = False) -> DataFrame:
    """``docs`` without the benchmark's words: hit spans are cut out of the text, or with ``whole`` the document goes.

    A document left without a word goes too. All columns of ``docs`` stay.
    """
    hits = find_hits(docs, benchmark, length).select("k1", "k2", "mask")
    inner, back = sealed(docs)
    some, rest = split_by_keys(inner.select("*", *row_key()), hits.select("k2"))
    rest = rest.select(*back)
    if whole:
        return some.join(hits, ["k1", "k2"], "left_anti").select(*back).union(rest)
    joined = some.join(hits, ["k1", "k2"], "left")
    # a token is a word with the separators before it; arguments of filter are evaluated once a row, its body once a token
    tokens = r"regexp_extract_all(text, '(?s)[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0)"
    left = F.expr(f"array_join(transform(filter(arrays_zip({tokens}, mask), x -> NOT coalesce(x.mask, false)), x -> x.`0`), '')")
    cut = joined.withColumn("text", F.when(F.col("mask").isNull(), F.col("text")).otherwise(left))
    return cut.where("mask IS NULL OR text <> ''").select(*back).union(rest)

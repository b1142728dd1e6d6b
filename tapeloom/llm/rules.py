"""Quality rules: base counts, and the divergence of a document's histograms from its language's reference.

Only DataFrame functions run. Two histograms are compared by Jensen-Shannon distance (base 2, 0 to 1): character classes, and the
language's most frequent words with one bin for all other words. References are counted over all documents and words of a language; one with
too few words to have a reference of its own is judged by that of all documents. A histogram with too few entries is not judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sealed

SPACES = r"[\x20\x09-\x0D]+"
#: Common words of a language.
COMMON = 16
#: Least words of a language with its own reference, and its least share of all words (one in so many), which bounds their number.
LEAST_REFERENCE, LEAST_SHARE = 10_000, 10_000
#: Histograms are judged from so many characters in words, and so many words, on, and fail above these distances.
MIN_CHARS, MIN_WORDS, MAX_CLASS_JS, MAX_WORD_JS = 200, 60, 0.27, 0.42
#: Words of a language are ranked in so many parts first.
PARTS = 64


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, the text ``t``, its words ``w``, ``word_chars`` and the class counts ``classes`` of every document."""
    out = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("t"))
    out = out.withColumns({"w": words_of(F.col("t")), "word_chars": F.length(F.regexp_replace("t", SPACES, ""))})
    # white space and a-z, nearly all of a text, go first; each further class is removed from what the last one left
    patterns = (r"[a-z\x20\x09-\x0D]+", "[A-Z]+", "[0-9]+", r"[.,;:!?'\x22()-]+", r"[\x00-\x7F]+")
    names = ["t"]
    for i, p in enumerate(patterns):
        out = out.withColumn(f"t{i}", F.regexp_replace(names[-1], p, ""))
        names.append(f"t{i}")
    spaces = F.length("t") - F.col("word_chars")
    counts = [F.length(a) - F.length(b) for a, b in zip(names, names[1:], strict=False)] + [F.length(names[-1])]
    classes = F.array(counts[0] - spaces, spaces, *counts[1:])
    return out.select(*keep, "t", "w", "word_chars", F.transform(classes, lambda x: x.cast("long")).alias("classes"))


def references(docs: DataFrame) -> DataFrame:
    """``lang, ref_words, ref_word_n, ref_classes``: for each language with words enough, and for null as the language of all documents."""
    named = measures(docs, ["lang"])
    classes = materialize(named.groupBy("lang").agg(*[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(7)]), "rules-classes")
    words = docs.select("lang", F.explode(words_of(F.coalesce(F.col("text"), F.lit("")))).alias("word"))
    counts = materialize(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "rules-words")
    sizes = materialize(counts.groupBy("lang").agg(F.sum("n").alias("n_words")), "rules-sizes")
    total = sizes.agg(F.sum("n_words")).first()[0] or 0
    enough = sizes.where(F.col("lang").isNotNull() & (F.col("n_words") >= max(LEAST_REFERENCE, -(-total // LEAST_SHARE))))  # at most LEAST_SHARE rows
    own = classes.join(F.broadcast(enough), "lang").select("lang", "n_words", *classes.columns[1:])
    all_classes = classes.agg(F.lit(None).cast("string").alias("lang"), F.lit(total).cast("long").alias("n_words"), *[F.sum(c).alias(c) for c in classes.columns[1:]])
    pooled = counts.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "word", "n")
    both = counts.join(F.broadcast(enough.select("lang")), "lang", "left_semi").unionByName(pooled)
    best = lambda *part: F.row_number().over(Window.partitionBy("lang", *part).orderBy(F.desc("n"), "word"))
    top = both.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS))).withColumn("r", best("part")).where(F.col("r") <= COMMON)
    top = top.withColumn("r", best()).where(F.col("r") <= COMMON)
    top = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "word", "n"))).alias("top"))
    every = own.unionByName(all_classes)
    joined = every.join(top, every.lang.eqNullSafe(top.lang), "left").select(every.lang, "n_words", "top", F.array(*[F.col(f"c{i}") for i in range(7)]).alias("ref_classes"))
    listed = F.expr("coalesce(transform(top, x -> x.n), array())")
    return joined.select(
        "lang", F.expr("coalesce(transform(top, x -> x.word), array())").alias("ref_words"),
        F.concat(listed, F.array(F.col("n_words") - F.aggregate(listed, F.lit(0).cast("long"), lambda a, x: a + x))).alias("ref_word_n"), "ref_classes",
    )


def js_distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two count arrays of equal length; 0 where either is empty."""
    pt, qt = (f"cast(aggregate({x}, 0L, (a, c) -> a + c) AS double)" for x in (p, q))
    shares = f"zip_with(transform({p}, c -> c / {pt}), transform({q}, c -> c / {qt}), (u, v) -> struct(u, v))"
    term = "if(x.u > 0, x.u * log2(2 * x.u / (x.u + x.v)), 0D) + if(x.v > 0, x.v * log2(2 * x.v / (x.u + x.v)), 0D)"
    return F.expr(f"if({pt} > 0 AND {qt} > 0, sqrt(greatest(0D, aggregate({shares}, 0D, (a, x) -> a + {term}) / 2)), 0D)")


def judge(docs: DataFrame) -> DataFrame:
    """Every column of ``docs`` with the base counts, ``base_failed``, ``class_js``, ``word_js`` and ``kept``; a column
    of ``docs`` with such a name is replaced.

    Null text has no words and fails the base rules, as any text of under 50 words does. A null language, or one without a reference of its own, is
    judged against the reference of all documents. Classes are judged from ``MIN_CHARS`` characters in words on, common words from ``MIN_WORDS``
    words on. Repeated rows are judged alike; an empty table gives no rows.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_js", "word_js", "kept"]
    docs, back = sealed(docs.drop(*made), "lang")
    refs = materialize(references(docs), "rules-references").withColumnRenamed("lang", "ref_lang")
    listed = F.broadcast(refs.where("ref_lang IS NOT NULL"))  # at most LEAST_SHARE languages
    every = refs.where("ref_lang IS NULL").selectExpr("ref_words AS all_words", "ref_word_n AS all_word_n", "ref_classes AS all_classes")
    m = measures(docs, docs.columns)
    m = m.withColumn("hw", F.expr("transform(w, x -> xxhash64(x))"))
    m = m.withColumn("g", F.expr("if(size(hw) >= 3, transform(slice(hw, 1, size(hw) - 2), (h, i) -> xxhash64(h, hw[i + 1], hw[i + 2])), array())"))
    span = "(9223372036854775807 div size(g))"
    m = m.withColumn("o", F.expr(f"if(size(array_distinct(g)) = size(g), array(), sort_array(transform(g, (h, i) -> pmod(h, {span}) * size(g) + i)))"))
    m = m.withColumn("p", F.expr("transform(o, x -> cast(x % size(g) AS int))"))
    repeat = "filter(p, (x, i) -> (i > 0 and g[x] = get(g, get(p, i - 1))) or g[x] = get(g, get(p, i + 1)))"
    m = m.withColumn("rep", F.expr(f"sort_array({repeat})"))
    lines = F.expr(r"filter(split(t, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')")
    m = m.withColumn("lines", lines)
    joined = m.join(listed, m.lang == listed.ref_lang, "left").crossJoin(F.broadcast(every.limit(1)))
    for c in ("words", "word_n", "classes"):
        joined = joined.withColumn(f"r_{c}", F.coalesce(f"ref_{c}", f"all_{c}"))
    joined = joined.withColumn("at", F.expr("filter(transform(w, x -> cast(array_position(r_words, x) AS int)), x -> x > 0)"))
    joined = joined.withColumn("hits", F.array(*[F.expr(f"cast(size(at) - size(array_remove(at, {i + 1})) AS bigint)") for i in range(COMMON)]))
    hist = "concat(slice(hits, 1, size(r_words)), array(size(w) - aggregate(hits, 0L, (a, x) -> a + x)))"
    counted = joined.select(
        *docs.columns,
        F.size("w").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(rep, named_struct('upto', 0, 'n', 0L), (a, x) -> named_struct('upto', x + 3, 'n', a.n + x + 3 - greatest(x, a.upto)), a -> a.n)").alias("n_repeat_words"),
        F.expr(hist).alias("hist"), "r_word_n", "classes", "r_classes",
    )
    scored = counted.withColumn("class_js", js_distance("classes", "r_classes")).withColumn("word_js", js_distance("hist", "r_word_n"))
    scored = scored.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    odd = ((F.col("word_chars") >= MIN_CHARS) & (F.col("class_js") > MAX_CLASS_JS)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_js") > MAX_WORD_JS))
    scored = scored.withColumn("kept", ~F.col("base_failed") & ~odd)
    return scored.select(*back, *made)

"""License scans by diagonal voting: rolling word grams of documents are joined with the places of license notices that hold them.

Only DataFrame functions run. A gram at word d of a document and at word t of a notice is a vote for the diagonal d - t. Votes are verified on the
words of the documents that have any (see ``split_by_keys``), neighbouring diagonals, which inserted or missing words tell apart, are merged, and the
share of a notice's words that a group of diagonals covers decides. Beside this, a few phrases are counted wherever they stand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, row_key, sealed, split_by_keys
from .decontaminate import item_words

#: Words of a gram, largest step between diagonals that are merged, and least share of a notice's words.
GRAM, GAP, LEAST_COVER = 3, 3, 0.6

#: Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Public license notices and their labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation"
     " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or"
     " at your option any later version", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
]


def gram_hashes(words: str) -> Column:
    """The hash of each run of GRAM words of an array column, by start."""
    parts = ", ".join(f"{words}[i + {j}]" for j in range(GRAM))
    return F.expr(f"if(size({words}) >= {GRAM}, transform(sequence(0, size({words}) - {GRAM}), i -> struct(i AS d, xxhash64({parts}) AS h)), array())")


def notice_grams(spark: SparkSession, notices: list[tuple[str, str]]) -> DataFrame:
    """``h, notice, t, gram``: every place of every notice; as many rows as the notices have words."""
    rows = spark.createDataFrame([(i, text.split(" ")) for i, (text, _) in enumerate(notices)], "notice int, w array<string>")
    grams = rows.select("notice", "w", F.explode(gram_hashes("w")).alias("x"))
    return grams.select("x.h", "notice", F.col("x.d").alias("t"), F.expr(f"array_join(slice(w, x.d + 1, {GRAM}), ' ')").alias("gram"))


def notice_spans(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, least_cover: float = LEAST_COVER) -> DataFrame:
    """``k1, k2, spans array<struct<start, end, notice, label, cover>>``: the verified spans of each document that has any, a written table."""
    spark = docs.sparkSession
    grams = notice_grams(spark, notices)
    keyed = docs.select(*row_key(), "text")
    rolled = keyed.select("k1", "k2", item_words(F.col("text")).alias("w")).select("k1", "k2", F.explode_outer(gram_hashes("w")).alias("x")).select("k1", "k2", "x.d", "x.h")
    voted = rolled.join(F.broadcast(grams.select("h", "notice", "t")), "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("d", "notice", "t")).alias("votes"))
    voted = materialize(voted, "licenses-votes")
    near = split_by_keys(keyed, voted.select("k2"))[0].join(voted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "votes", item_words(F.col("text")).alias("w"))
    read = F.expr(f"transform(votes, v -> struct(v.d, v.notice, v.t, array_join(slice(w, v.d + 1, {GRAM}), ' ') AS gram))")
    votes = near.select("k1", "k2", F.explode_outer(read).alias("v")).select("k1", "k2", "v.*").join(F.broadcast(grams.drop("h")), ["notice", "t", "gram"])
    lines = votes.groupBy("k1", "k2", "notice", (F.col("d") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"), F.min("d").alias("start"), F.max("d").alias("end"))
    by = Window.partitionBy("k1", "k2", "notice").orderBy("diagonal")
    lines = lines.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by) > GAP).cast("int")).withColumn("group", F.sum(F.coalesce("new", F.lit(0))).over(by))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("ts")), lambda t: F.sequence(t, t + GRAM - 1)))))
    groups = lines.groupBy("k1", "k2", "notice", "group").agg(covered.alias("covered"), F.min("start").cast("long").alias("start"), (F.max("end") + GRAM).cast("long").alias("end"))
    sizes = spark.createDataFrame([(i, len(text.split(" ")), label) for i, (text, label) in enumerate(notices)], "notice int, size int, label string")
    spans = groups.join(F.broadcast(sizes), "notice").withColumn("cover", F.col("covered") / F.col("size")).where(F.col("cover") >= least_cover)
    return materialize(spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "end", "notice", "label", "cover"))).alias("spans")), "licenses-spans")


def phrase_places(words: str, phrase: str) -> str:
    """SQL for the starts of ``phrase`` in an array column; the words are searched one by one only where the text has it at all."""
    parts = phrase.split(" ")
    same = " AND ".join(f"{words}[i + {j}] = '{p}'" for j, p in enumerate(parts))
    return f"if(contains(joined, ' {phrase} '), filter(sequence(0, size({words}) - {len(parts)}), i -> {same}), array())"


def scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """Every column of ``docs`` with ``n_words, n_base, first_word, last_word, base_labels, labels, score, spans``; a column of ``docs`` with such a name is replaced.

    n_base counts the places of the phrases, which give the base labels; spans are the verified stretches of notices (start, end in words), which
    add labels; score is the largest covered share of a notice, 0 without one.

    A null or wordless text has no words, places or spans, its labels are empty. Overlapping and repeated places all count. Repeated rows are
    judged alike; texts of any length are read whole; an empty table gives no rows.
    """
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    docs, back = sealed(docs.drop(*made))
    found = notice_spans(docs, notices)
    places = "flatten(array(" + ", ".join(f"transform({phrase_places('w', p)}, i -> struct(i AS at, '{label}' AS label))" for p, label in phrases) + "))"

    def measured(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("w", item_words(F.col("text"))).withColumn("joined", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
        rows = rows.withColumn("places", F.expr(places)).withColumn("n_words", F.size("w").cast("long"))
        return rows.drop("w", "joined")

    some, rest = split_by_keys(docs.select("*", *row_key()), found.select("k2"))
    none = F.lit(None).cast(found.schema["spans"].dataType)
    every = measured(some).join(found, ["k1", "k2"], "left").select(*docs.columns, "places", "n_words", "spans").union(measured(rest).select(*docs.columns, "places", "n_words", none.alias("spans")))
    spans = every.withColumns({
        "spans": F.expr("coalesce(spans, array())"), "n_base": F.size("places").cast("long"),
        "first_word": F.expr("cast(array_min(places.at) AS bigint)"), "last_word": F.expr("cast(array_max(places.at) AS bigint)"),
    })
    listed = lambda *labels: F.array_join(F.array_sort(F.array_distinct(reduce(F.concat, labels))), ",")
    named = spans.withColumns({
        "base_labels": listed(F.col("places.label")), "labels": listed(F.col("places.label"), F.col("spans.label")),
        "score": F.coalesce(F.array_max("spans.cover"), F.lit(0.0)),
    })
    return named.select(*back, *made)

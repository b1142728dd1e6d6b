"""URL filters: a temporal list join.

Dated list entries (add or remove a domain, a host path or a URL) become validity intervals; every capture is evaluated against the
entries that were active when it was fetched. Only DataFrame functions run. The intervals of one list value are one row,
so the join is an equi-join that cannot multiply rows, and the as-of test looks into that row. A capture is expanded as far as the longest
domain and path on the list reach, so no entry is out of reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast

MADE = ["host", "n_matches", "matches", "blocked"]


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port or trailing dot, an IPv6 address in its brackets; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1), r"\.+$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """``kind, value, spans array<struct<since, until>>`` from ``kind, value, action, listed_at``.

    An ``add`` opens an interval and the next ``remove`` closes it; adds to an open one and removes from a closed one change nothing. At
    one instant removals come first, so a value removed and added at once is listed. Rows with a null are left out, repeated rows count once.
    """
    dated = entries.select(F.lower("kind").alias("kind"), F.lower("value").alias("value"), F.lower("action").alias("action"), "listed_at").dropna().where("action IN ('add', 'remove')").distinct()
    order = Window.partitionBy("kind", "value").orderBy("listed_at", F.desc("action"))
    turns = dated.withColumn("before", F.lag("action").over(order)).where("action <> coalesce(before, 'remove')")
    spans = turns.withColumn("until", F.lead("listed_at").over(order)).where("action = 'add'")
    spans = spans.where("until IS NULL OR until > listed_at")
    return spans.groupBy("kind", "value").agg(F.array_sort(F.collect_list(F.struct(F.col("listed_at").alias("since"), "until"))).alias("spans"))


def list_keys(url: Column, most_labels: int, most_parts: int) -> Column:
    """The list values that can cover ``url``: its host and parent domains, host and leading path parts, and itself without fragment.

    Domains of more than ``most_labels`` labels and paths of more than ``most_parts`` parts are left out; no entry may be longer.
    """
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(_up_to(F.least(F.size(labels), F.lit(most_labels))), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))
    parts = F.array_remove(F.split(F.lower(path), "/"), "")
    paths = F.transform(_up_to(F.least(F.size(parts), F.lit(most_parts))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    tagged = F.concat(
        F.transform(domains, lambda v: F.struct(F.lit("domain").alias("kind"), v.alias("value"))),
        F.transform(paths, lambda v: F.struct(F.lit("path").alias("kind"), v.alias("value"))),
        F.array(F.struct(F.lit("url").alias("kind"), F.lower(F.regexp_replace(url, "#.*$", "")).alias("value"))),
    )
    return F.array_distinct(F.when(host == "", F.array().cast(tagged_type())).otherwise(tagged))


def _up_to(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def tagged_type() -> str:
    return "array<struct<kind:string,value:string>>"


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (any columns with ``url`` and ``fetched_at``) with ``host``, ``n_matches``, ``matches`` and ``blocked``; columns of these names are
    replaced.

    A null or unparsable URL has no host and matches nothing; a null fetch time is inside no interval. An entry is active from its
    listing (included) to its removal (excluded). The verdict follows from URL and fetch time alone: captures that repeat both are
    evaluated together and each returned, and no other column, an id neither, takes part. Empty tables give no rows, or no matches.
    """
    spans = materialize(intervals(entries), "url-intervals")
    longest = lambda kind, mark: F.coalesce(F.max(F.when(F.col("kind") == kind, F.size(F.split("value", mark)))), F.lit(0))
    labels, parts = spans.agg(longest("domain", r"\."), longest("path", "/") - 1).first()
    kept = [c for c in captures.columns if c not in MADE]
    sealed = captures.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("c"), "url", "fetched_at", F.xxhash64("url").alias("u1"), F.xxhash64(F.lit(1), "url").alias("u2"))
    asked = sealed.where("url IS NOT NULL AND fetched_at IS NOT NULL").select("u1", "u2", "fetched_at", F.explode_outer(list_keys(F.col("url"), labels, parts)).alias("k")).distinct()
    asked = asked.select("u1", "u2", "fetched_at", "k.kind", "k.value").where("value IS NOT NULL")
    listed = maybe_broadcast(spans, F.octet_length("value") + 32 * F.size("spans"))
    active = asked.join(listed, ["kind", "value"]).where("exists(spans, s -> s.since <= fetched_at AND (s.until IS NULL OR fetched_at < s.until))")
    found = active.groupBy("u1", "u2", "fetched_at").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "value"))).alias("matches"))
    out = sealed.join(found, ["u1", "u2", "fetched_at"], "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<string>")))
    made = [host_of(F.col("url")).alias("host"), F.size("matches").cast("long").alias("n_matches"), F.col("matches"), (F.size("matches") > 0).alias("blocked")]
    return out.select(*[F.col(f"c.c{i}").alias(c) for i, c in enumerate(kept)], *made)


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures from ``pages``: the fetch time is a fixed function of page_id, over 90 days from 2024-01-01."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("page_id") * 7919, F.lit(90 * 24)) * 3600)
    return pages.select(F.col("page_id").alias("capture_id"), "url", at.alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list derived from the hosts of ``pages``: about a third of the hosts and some first path parts are added, most are removed
    later, and some come back."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    value = hosts.select(F.lit("domain").alias("kind"), F.col("host").alias("value")).union(hosts.where("path <> '' AND path <> '/'").select(F.lit("path"), F.concat("host", F.lit("/"), F.lower(F.split_part("path", F.lit("/"), F.lit(2))))))
    named = value.distinct().withColumn("c", F.conv(F.substring(F.md5(F.col("value").cast("binary")), 1, 7), 16, 10).cast("long")).where("c % 3 = 0")
    day = lambda n: F.timestamp_seconds(F.lit(1_704_067_200) + n * 86_400)
    rows = F.array(
        F.struct(F.lit("add").alias("action"), day(F.col("c") % 50).alias("listed_at")),
        F.struct(F.when(F.col("c") % 4 > 0, "remove").alias("action"), day(F.col("c") % 50 + 10 + F.col("c") % 17).alias("listed_at")),
        F.struct(F.when(F.col("c") % 8 == 1, "add").alias("action"), day(F.col("c") % 50 + 33).alias("listed_at")),
    )
    return named.select("kind", "value", F.inline(rows)).where("action IS NOT NULL")

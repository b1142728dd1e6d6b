"""Line dedup by pairwise alignment.

Two documents overlap when they share a rare line, one that at most a share of ``RARE_SHARE`` of all documents holds (or ``RARE_LEAST`` documents, in
small tables). Each rare line pairs every later holder with the earliest one, however many they are. A pair's lines with words are aligned by patience
diff, ranges without lines unique on both sides by a longest common subsequence. A block, aligned lines that follow each other in both documents, is deleted
from the later one if it has ``BLOCK_CHARS`` characters and holds a rare line of this pair: common and short lines inside it go too, the same lines elsewhere
stay. What is left is aligned again until no block goes, so that blocks in another order go as well. Nothing else deletes lines.

Documents with equal lines are one class: its first member stands for it, all lines of the others go. The earliest holder of a line that very many
share meets them in groups of bounded size, to each of which its lines are sent once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, row_key, sealed, split_by_keys

#: Characters that a block must have to go; those of one line are counted up to this number.
BLOCK_CHARS = 20
#: A line is rare if at most this share of all documents (classes of equal ones) holds it, or this many do.
RARE_SHARE, RARE_LEAST = 0.5, 64
#: Lines that a group of pairs has, apart from its last document.
GROUP_LINES = 1 << 17
_TRIMMED = r"trim(BOTH ' \t\r\u000B\u000C' FROM l)"
_LINES = r"""transform(split(text, '\n'), l -> if(l RLIKE '[^\\x20\\x09-\\x0D]', xxhash64({seed}, {trimmed}) | 1L, 0L))"""


def hashed_lines(docs: DataFrame) -> DataFrame:
    """``k1, k2, class, lines, checks, sizes`` of every document with words: two hashes of each line without surrounding white space (0 if it has
    no word), its characters up to ``BLOCK_CHARS``, and 128 bits of all hashes."""
    keyed = docs.select(*row_key(), "text").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    lines, checks = (F.expr(_LINES.format(seed=seed, trimmed=_TRIMMED)) for seed in (1, 2))
    sizes = F.expr(rf"transform(split(text, '\n'), l -> least(length({_TRIMMED}), {BLOCK_CHARS}))")
    hashed = keyed.select("k1", "k2", lines.alias("lines"), checks.alias("checks"), sizes.alias("sizes"))
    return hashed.withColumn("class", F.struct(F.xxhash64("lines"), F.xxhash64("checks"))).dropDuplicates(["k1", "k2"])


#: Rows of the longest-common-subsequence table are kept while they have no more bits than this; longer ranges are halved first.
_TABLE_BITS = 1 << 26


def _lcs_rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Rows of the table, one a prefix of ``a`` (the last only, unless ``keep``): bit j is 0 where b[: j + 1] has one more common line than b[:j]."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lcs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence: bit-parallel, halved as Hirschberg does where the table would be large."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 == i1 or j0 == j1:
            continue
        if i1 - i0 > 1 and (i1 - i0) * (j1 - j0) > _TABLE_BITS:
            mid, n = (i0 + i1) // 2, j1 - j0
            head = f"{_lcs_rows(a[i0:mid], b[j0:j1], False)[0]:0{n}b}"[::-1]
            tail = f"{_lcs_rows(a[mid:i1][::-1], b[j0:j1][::-1], False)[0]:0{n}b}"[::-1]
            total = tail.count("0")
            best, cut = total, 0
            for j in range(n):
                total += (head[j] == "0") - (tail[n - 1 - j] == "0")
                if total > best:
                    best, cut = total, j + 1
            todo += [(i0, mid, j0, j0 + cut), (mid, i1, j0 + cut, j1)]
            continue
        rows = _lcs_rows(a[i0:i1], b[j0:j1], True)
        i, j = i1 - i0, j1 - j0
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i0 + i, j0 + j))
    return sorted(out)


def repeated_pairs(a: list[int], b: list[int], i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int]]:
    """Aligned lines of a range without lines unique on both sides: a longest common subsequence, moved together into blocks."""
    common = set(a[i0:i1]) & set(b[j0:j1])
    if not common:
        return []
    left, right = [i for i in range(i0, i1) if a[i] in common], [j for j in range(j0, j1) if b[j] in common]
    pairs = [(left[i], right[j]) for i, j in _lcs([a[i] for i in left], [b[j] for j in right])]
    for n in range(len(pairs) - 2, -1, -1):
        i, j = pairs[n + 1][0] - 1, pairs[n + 1][1] - 1
        if a[i] == b[j]:
            pairs[n] = (i, j)
    return pairs


def patience_blocks(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs (i, j), increasing in both, of aligned equal lines."""
    # of chains of unique lines that are equally long, the one that ends first in ``b``
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        where = {b[j]: j for j in range(j0, j1) if in_b[b[j]] == 1}
        both = [(i, where[a[i]]) for i in range(i0, i1) if in_a[a[i]] == 1 and a[i] in where]
        if not both:
            out += repeated_pairs(a, b, i0, i1, j0, j1)
            continue
        # the longest increasing run of positions in b: piles, as in patience sorting, with links back
        tops: list[int] = []
        pile: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(both):
            k = bisect_left(tops, j)
            back.append(pile[k - 1] if k else -1)
            if k == len(tops):
                tops.append(j)
                pile.append(n)
            else:
                tops[k], pile[k] = j, n
        chain, n = [], pile[-1]
        while n >= 0:
            chain.append(both[n])
            n = back[n]
        at = (i0, j0)
        for i, j in reversed(chain):
            out.append((i, j))
            todo.append((at[0], i, at[1], j))
            at = (i + 1, j + 1)
        todo.append((at[0], i1, at[1], j1))
    return sorted(out)


def lines_to_delete(early: list[int], late: list[int], sizes: list[int], rare: set[int]) -> set[int]:
    """Line numbers of ``late`` that go, by alignment with ``early``; 0 is a line without a word, ``rare`` has line numbers of ``late``."""
    early = [h for h in early if h]
    worded = [j for j, h in enumerate(late) if h]
    rank = {j: n for n, j in enumerate(worded)}  # lines without words between two lines do not part them
    gone: set[int] = set()
    left = worded
    while not gone.issuperset(rare):
        found: set[int] = set()
        block: list[int] = []
        last = None
        for i, at in [*patience_blocks(early, [late[j] for j in left]), (-2, -2)]:
            here = (i, rank[left[at]]) if at >= 0 else None
            if block and (here is None or last != (here[0] - 1, here[1] - 1)):
                if sum(sizes[j] for j in block) >= BLOCK_CHARS and not rare.isdisjoint(block):
                    found.update(block)
                block = []
            if here is not None:
                block.append(left[at])
            last = here
        if not found:
            break
        gone |= found
        left = [j for j in left if j not in found]
    return gone


def with_empty_lines(gone: set[int], hashes: list[int]) -> list[int]:
    """``gone`` in order, with the lines without words between two lines that go, or between one and the text's edge; no other such line."""
    out, held, open_ = [], [], True
    for j, h in enumerate(hashes):
        if not h:
            held.append(j)
        elif j in gone:
            out += [*(held if open_ else ()), j]
            held, open_ = [], True
        else:
            held, open_ = [], False
    return out + (held if open_ else [])


def _align(early: pa.Table, late: pa.Table) -> pa.Table:
    """The lines that go from the later documents of a group of pairs."""
    hubs = dict(zip(zip(early.column("e1").to_pylist(), early.column("e2").to_pylist(), strict=True), early.column("early").to_pylist(), strict=True))
    k1, k2, gone = [], [], []
    for n in range(late.num_rows):
        row = {c: late.column(c)[n].as_py() for c in ("e1", "e2", "k1", "k2", "lines", "checks", "sizes", "via")}
        via = set(row["via"])
        own = lines_to_delete(hubs[row["e1"], row["e2"]], row["checks"], row["sizes"], {j for j, h in enumerate(row["lines"]) if h in via})
        if own:
            k1.append(row["k1"])
            k2.append(row["k2"])
            gone.append(sorted(own))
    return pa.table([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["k1", "k2", "gone"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that go with the lines without words between them."""
    for batch in batches:
        out = [with_empty_lines(set(gone), lines) for lines, gone in zip(batch.column("lines").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("k1"), batch.column("k2"), pa.array(out, pa.list_(pa.int32()))], names=["k1", "k2", "gone"])


def overlapping_pairs(firsts: DataFrame) -> DataFrame:
    """``k1, k2, e1, e2, n, via``: each document of ``firsts`` with the earliest holders of its rare lines, its number of lines and the rare lines."""
    keys = materialize(firsts.select("k1", "k2", F.size("lines").alias("n"), F.explode(F.array_distinct("lines")).alias("h")).where("h <> 0"), "lines-keys")
    most = max(RARE_LEAST, int(firsts.count() * RARE_SHARE))
    held = keys.groupBy("h").agg(F.min(F.struct("k1", "k2")).alias("e"), F.count(F.lit(1)).alias("holders")).where(F.col("holders").between(2, most)).select("h", "e")
    held = materialize(held, "lines-held")
    later = keys.join(held, "h").where("e <> struct(k1, k2)")
    pairs = later.groupBy("k1", "k2", F.col("e.k1").alias("e1"), F.col("e.k2").alias("e2")).agg(F.first("n").alias("n"), F.collect_set("h").alias("via"))
    pairs = materialize(pairs, "lines-pairs")
    discard(keys)
    discard(held)
    return pairs


def find_copied_lines(docs: DataFrame) -> DataFrame:
    """``k1, k2, gone array<int>``: the line numbers to delete from each later document; null stands for all lines."""
    hashed = materialize(hashed_lines(docs), "lines-hashes")
    classes = hashed.groupBy("class").agg(F.min(F.struct("k1", "k2")).alias("e"), F.count(F.lit(1)).alias("n")).where("n > 1").select("class", "e")
    classes = materialize(classes, "lines-classes")  # plain inputs let Spark split the partition of a large class or a very common line
    copies = materialize(hashed.select("class", "k1", "k2").join(classes, "class").where("e <> struct(k1, k2)").select("k1", "k2"), "lines-copies")
    firsts = materialize(hashed.join(copies, ["k1", "k2"], "left_anti").select("k1", "k2", "lines", "checks", "sizes"), "lines-firsts")
    pairs = overlapping_pairs(firsts)
    hubs = pairs.groupBy("e1", "e2").agg(F.sum("n").alias("n")).join(firsts.select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("checks").alias("early")), ["e1", "e2"])
    hubs = materialize(hubs.withColumn("salts", F.ceil(F.col("n") / GROUP_LINES)), "lines-hubs")
    total = hubs.agg(F.sum(F.col("n") + F.col("salts") * F.size("early"))).first()[0] or 0
    group = F.pmod(F.xxhash64("e1", "e2", "salt"), F.lit(total // GROUP_LINES + 1)).alias("g")
    early = hubs.select("e1", "e2", "early", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).select(group, "e1", "e2", "early")
    late = pairs.join(hubs.select("e1", "e2", "salts"), ["e1", "e2"]).withColumn("salt", F.pmod(F.xxhash64("k1", "k2"), F.col("salts")))
    late = late.select(group, "e1", "e2", "k1", "k2", "via").join(firsts, ["k1", "k2"])
    found = early.groupBy("g").cogroup(late.groupBy("g")).applyInArrow(_align, "k1 long, k2 long, gone array<int>")
    found = found.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    gone = found.join(firsts, ["k1", "k2"]).select("k1", "k2", "lines", "gone").mapInArrow(_settle, "k1 long, k2 long, gone array<int>")
    gone = materialize(gone.union(copies.withColumn("gone", F.expr("cast(NULL AS array<int>)"))), "lines-gone")
    for written in (hashed, classes, copies, firsts, pairs, hubs):
        discard(written)
    return gone


def with_deletions(inner: DataFrame) -> DataFrame:
    """``inner`` with ``_gone``, the number of deleted lines, and ``_left``, the text that stays."""
    gone = find_copied_lines(inner)
    # a mask of the lines up to the last deleted one: arguments of these functions are evaluated once a row, their bodies once a line
    mask = F.expr("flatten(zip_with(gone, concat(array(-1), gone), (x, p) -> if(x IS NULL, array(), concat(array_repeat(false, x - p - 1), array(true)))))")
    some, rest = split_by_keys(inner.select("*", *row_key()), gone.select("k2"))
    joined = some.join(gone.select("k1", "k2", "gone", mask.alias("mask"), F.lit(True).alias("cut")), ["k1", "k2"], "left")
    left = F.expr(r"array_join(transform(filter(arrays_zip(split(text, '\n'), mask), x -> NOT coalesce(x.mask, false)), x -> x.`0`), '\n')")
    n_gone = F.when(F.col("cut").isNull(), 0).otherwise(F.coalesce(F.size("gone"), F.size(F.split("text", "\n")))).cast("long")
    text = F.when(F.col("cut").isNull(), F.col("text")).when(F.col("gone").isNull(), F.lit("")).otherwise(left)
    return joined.select(*inner.columns, n_gone.alias("_gone"), text.alias("_left")).union(rest.select(*inner.columns, F.lit(0).cast("long").alias("_gone"), F.col("text").alias("_left")))


def line_summary(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` of every document; null text has no lines and the digest of nothing.

    Documents are ordered by doc_id (null counts as 0, an id that is no whole number by its hash) and then by text hash; rows with equal doc_id and
    text are one document and are treated alike. The earliest holder of a line keeps it. Lines are compared without surrounding white space, so line ends do not matter; lines without
    words go only between others that go. An empty table gives no rows.
    """
    found = with_deletions(docs.select("doc_id", "text"))
    return found.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.col("_gone").alias("n_removed"), F.sha2(F.coalesce(F.col("_left"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def drop_copied_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the copied lines; a document that had words and loses them all goes."""
    inner, back = sealed(docs)
    found = with_deletions(inner)
    emptied = (F.col("_gone") > 0) & ~F.col("_left").rlike(r"[^\x20\x09-\x0D]")
    return found.where(~F.coalesce(emptied, F.lit(False))).withColumn("text", F.col("_left")).select(*back)

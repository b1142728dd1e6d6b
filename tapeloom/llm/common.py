"""What the operators share: inputs, scratch tables, row keys, gapless numbering, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Upper bound, in counted bytes, of a table that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows of whole texts that a task's Python turns into objects at once.
TEXT_ROWS = 1024
#: Most keys that a broadcast bitmap is made of.
FILTER_KEYS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``; freed memory is given back at the start and the end, since the process waits for later stages."""
    release()
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
    release()


def release() -> None:
    """Give memory that this process has freed back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; where it is unset, a local session (as in tests) gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tapeloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: computed once, and lineage is cut.

    A lost executor costs a re-read, not a recomputation. The folder belongs to the session; whoever owns it clears it.
    """
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> list[Column]:
    """Two columns that address a document, null ids and repeated ids included.

    Rows with equal id and equal text are interchangeable, so they may share a key; any others differ. The first column orders documents as
    whole-number ids do; an id that is no whole number stands there by its hash, a null as 0.
    """
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    number = F.coalesce(doc_id.try_cast("long"), F.when(doc_id.isNotNull(), F.xxhash64(doc_id)), F.lit(0))
    return [number.alias("k1"), F.xxhash64(doc_id, text).alias("k2")]


def sealed(docs: DataFrame, *also: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` as doc_id, text, ``also`` and one struct of all other columns, and the columns that undo this.

    An operator that passes columns through works on the sealed form, where no name of its own can clash with theirs.
    """
    own = ["doc_id", "text", *also]
    rest = [c for c in docs.columns if c not in own]
    inner = docs.select(*own, F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("_rest"))
    back = {c: F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(rest)}
    return inner, [back.get(c, F.col(c) if c in own else None) for c in docs.columns]


def maybe_broadcast(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when the rows of ``df``, a written table, are counted to have at most ``limit`` bytes by ``size``; otherwise the join shuffles."""
    held = df.agg(F.sum(size.cast("long") + 32)).first()[0] or 0
    return F.broadcast(df) if held <= limit else df


def split_by_keys(rows: DataFrame, found: DataFrame, key: str = "k2") -> tuple[DataFrame, DataFrame]:
    """``rows`` in two by their column ``key``: those that may be among the rows of ``found`` (all that are, and few others), and the rest.

    A bitmap of hashed keys is broadcast, of 16 to 32 bits a key and at most 32 MB, so that a join with ``found`` shuffles hardly more than the
    rows it needs. Beyond ``FILTER_KEYS`` keys, where the bitmap would let most rows through, all rows are in the first part.
    """
    n = found.count()
    if n > FILTER_KEYS:
        return rows, rows.where("false")
    bits = 1 << max(16, min(28, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    marked = found.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 + 1 AS int), 1)")), 16, 10).cast("int")
    tested = rows.withColumns({"_bucket": F.bitmap_bucket_number(place), "_at": at}).join(F.broadcast(marked), "_bucket", "left")
    hit = F.coalesce(F.expr("shiftright(_byte, cast(_at % 8 AS int)) & 1 = 1"), F.lit(False))
    tested = tested.withColumn("_byte", byte).withColumn("_hit", hit)
    return tested.where("_hit").select(*rows.columns), tested.where("NOT _hit").select(*rows.columns)


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, salts: int = 256) -> DataFrame:
    """Gapless numbers from 0 within ``keys``, without bringing one key's rows together.

    Rows of a key are dealt to ``salts`` sub-groups by a hash of ``order``, which must tell rows apart. A window numbers each sub-group, and
    the sub-group sizes (at most ``salts`` rows a key) give the offsets.
    """
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = dealt.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    own = Window.partitionBy(*keys, "_salt").orderBy(*order)
    joined = dealt.join(offsets, [*keys, "_salt"])
    return joined.withColumn(out, F.col("_off") + F.row_number().over(own) - 1).drop("_salt", "_off")


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; ``root`` is the least node of its component.

    Large-star and small-star in turn (Kiveris et al., 2014): every node sends its larger neighbours, and then its smaller ones and itself, to
    the least of its neighbourhood. Distances halve each round, so ordered paths too end in logarithmically many; the number of edges does not grow.
    Each round is written, which cuts lineage, and the round before it is removed.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs = materialize(pairs, f"{label}-edges")
    # done when no node is the lesser end of one edge and the greater of another: all are stars around their least node
    while not pairs.select("a").join(pairs.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = pairs.join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        sent = large.join(small, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("e"))
        before, pairs = pairs, materialize(sent.select("e.a", "e.b").where("a < b").distinct(), f"{label}-edges")
        discard(before)
    return pairs.select("b", "a").union(pairs.select("a", "a").distinct()).toDF("node", "root")


def discard(written: DataFrame) -> None:
    """Remove a scratch table that nothing reads any more."""
    jvm, files = written.sparkSession._jvm, written.inputFiles()
    if files:
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(written.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

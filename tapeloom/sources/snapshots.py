"""Tables in one folder behind a snapshot pointer: readers see whole commits only, and writers that meet each other try again.

A commit writes its rows to new folders, ``<table>/commit=<id>/..``, and then publishes the next numbered snapshot, a small file that lists the commits of each table, by a rename that
fails if somebody else has published that number. A writer that dies before leaves a folder that no snapshot lists, and a writer that comes second merges its rows with the new snapshot.
Rows are added, never rewritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SnapshotStore:
    """Named tables of one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def version(self) -> int:
        """The number of the latest snapshot, 0 before the first."""
        fs, p = self._fs(f"{self.path}/_snapshots")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def snapshot(self, version: int | None = None) -> dict:
        """``{table: {"schema": .., "commits": [..]}}`` of a version (default: the latest); commits in the order they were made."""
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/_snapshots/{version}", wholetext=True).first()[0])

    def read(self, table: str, version: int | None = None, order: str | None = None) -> DataFrame | None:
        """The table as of a snapshot, None if it has none of it; ``order`` names a column for the place of each row's commit."""
        return self._read(self.snapshot(version), table, order)

    def _read(self, snapshot: dict, table: str, order: str | None = None) -> DataFrame | None:
        entry = snapshot.get(table)
        if entry is None:
            return None
        schema = StructType.fromJson(entry["schema"])
        rows = self.spark.read.schema(StructType(schema.fields).add("commit", "string")).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/commit={c}" for c in entry["commits"]])
        place = F.array_position(F.array(*[F.lit(c) for c in entry["commits"]]), F.col("commit"))
        return rows.select(*schema.names, *([place.alias(order)] if order else []))

    def commit(self, made: Callable[[Callable[[str], DataFrame | None]], dict[str, DataFrame]], partition_by: dict[str, list[str]] | None = None, replace: bool = False, attempts: int = 10) -> int:
        """Add what ``made`` makes of the tables it reads (``made(read)``, tables by name) as one snapshot, and return its number.

        If another writer publishes first, ``made`` runs again on what that one left. With ``replace`` the tables written hold nothing else afterwards.
        """
        for _ in range(attempts):
            version = self.version()
            base = self.snapshot(version)
            name, after = uuid.uuid4().hex, dict(base)
            for table, df in made(lambda t, base=base: self._read(base, t)).items():
                df.write.partitionBy(*(partition_by or {}).get(table, [])).parquet(f"{self.path}/{table}/commit={name}")
                before = [] if replace or table not in base else base[table]["commits"]
                after[table] = {"schema": json.loads(df.schema.json()), "commits": [*before, name]}
            if self._publish(version + 1, json.dumps(after)):
                return version + 1
        raise RuntimeError(f"{attempts} other writers came first at {self.path}")

    def _publish(self, version: int, text: str) -> bool:
        """Put a snapshot in place, unless its number is taken."""
        jvm, own = self.spark._jvm, f"{self.path}/_snapshots/.{uuid.uuid4().hex}"
        fs, p = self._fs(own)
        out = fs.create(p)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), fs.getConf())
        try:
            context.rename(p, jvm.org.apache.hadoop.fs.Path(f"{self.path}/_snapshots/{version}"), self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(p, False)
            if self.version() >= version:
                return False
            raise e
        return True


def missing_rows(rows: DataFrame, stored: DataFrame | None, parts: list[str], key: list[str]) -> DataFrame:
    """``rows`` whose ``key`` the store lacks, each key once; only the parts (partition columns) that ``rows`` touch are read."""
    rows = rows.dropDuplicates([*parts, *key])
    if stored is None:
        return rows
    touched = stored.select(*parts, *key).join(rows.select(*parts).distinct(), parts, "left_semi")
    return rows.join(touched, [*parts, *key], "left_anti")


def latest_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The rows of each key's last commit."""
    last: Column = F.max(order).alias(order)
    return rows.join(rows.groupBy(*key).agg(last), [*key, order], "left_semi").drop(order)

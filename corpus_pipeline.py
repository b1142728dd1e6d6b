"""The corpus pipeline: quality classifier, line dedup, MinHash near-dedup, benchmark decontamination, SentencePiece encoding.

Each stage is written as Parquet in the shared folder and reread as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import decontaminate, lines, neardup, pieces, quality
from tapeloom.llm.common import materialize, table
from tapeloom.llm.queries import PIECES


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines aligned with an earlier document go, and documents left without words."""
    return lines.drop_copied_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return neardup.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts; documents left without words go."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document."""
    return pieces.encode_documents(docs, pieces.Vocabulary.load(PIECES), ["doc_id"])


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_copied_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("encoding", encode),
]

#: Not expressible in SQL (learned scores, patience alignment); tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs

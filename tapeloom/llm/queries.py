"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, language, licenses, lines, neardup, negatives, pieces, quality, rules, sharding, substring, urls
from .common import table
from .oracles import ORACLES as ORACLES


#: Vocabulary file of the SentencePiece query.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = urls.evaluate(urls.captures_of(pages), urls.entries_of(pages))
    return found.select(F.col("capture_id").alias("page_id"), "host", "n_matches", F.array_join("matches", " ").alias("matches"), "blocked")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.Vocabulary.load(PIECES)
    return pieces.encode_documents(table(spark, sf_dir, "documents"), vocabulary, ["doc_id"], digest_only=True)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_summary(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.held_out()
    model = language.train(docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~out))
    marked = docs.select("doc_id", "text", out.alias("held_out"))
    return language.identify(marked, model, ["doc_id", "held_out"])


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.grade_documents(docs, table(spark, sf_dir, "labels")).select("doc_id", "expected_grade", "p_high", "kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    packed = packed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    return packed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "cut")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_summary(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", negatives.turned_labels()))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_sentencepiece, op3_substring_dedup, op4_language_id, op5_quality_classifier, op6_decontamination, op7_sharding, op8_quality_rules, op9_line_dedup, op10_minhash, op11_hard_negatives, op12_collocations, op13_license_scans)}

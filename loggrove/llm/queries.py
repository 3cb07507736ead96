"""The queries of this subpackage, with production parameters over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base_sql, bpe, common, contamination, linededup, neardup, pii, quality, secrets, suffixdedup, tokenfile, vectors


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup(common.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(common.table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(common.table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(common.table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove(common.table(spark, sf_dir, "documents"), keep_bytes=False)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read(tokenfile.write(common.table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=2))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(common.table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near(common.table(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digests(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_pii gives that SQL can express."""
    return op4_pii(spark, sf_dir).drop("spans")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8_secret_scan gives that SQL can express."""
    return op8_secret_scan(spark, sf_dir).drop("spans")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_minhash_near_dedup, op3_quality_classifier, op4_pii, op5_bpe_codec, op6_suffix_dedup, op7_token_files, op8_secret_scan, op9_embedding_near_dedup, op10_decontamination, pii_base, secret_base)}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": linededup.oracle(), "op10_decontamination": contamination.oracle(), "op9_embedding_near_dedup": vectors.oracle(), "pii_base": base_sql.oracle(base_sql.PII), "secret_base": base_sql.oracle(base_sql.SECRETS)}

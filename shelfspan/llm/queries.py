"""The dealt queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.llm import centroids, lines, mixing
from shelfspan.llm.alignment import token_alignment
from shelfspan.llm.contamination import decontaminate
from shelfspan.llm.jaccard import jaccard_components
from shelfspan.llm.language_id import language_ids
from shelfspan.llm.language_model import language_scores
from shelfspan.llm.pages import main_texts
from shelfspan.llm.quality import BASE, quality_rules
from shelfspan.llm.substrings import substring_dedup
from shelfspan.llm.tokens import token_counts
from shelfspan.llm.toxicity import toxicity

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


#: Rows of an Arrow batch: a row holds a whole text, so batches have fewer rows than usual.
BATCH_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int, held: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == held


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept", "quality")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), Path(public_tokenizers.path(TOKENIZER)).read_text())


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op6_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"), fold(5, 1))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleared = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleared.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(3, 1))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = Path(public_tokenizers.path(BYTE_TOKENIZER)), Path(public_tokenizers.path(PIECE_TOKENIZER))
    aligned = token_alignment(table(spark, sf_dir, "documents"), a.read_text(), b.read_bytes())
    return aligned.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")


def op12_language_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(table(spark, sf_dir, "documents"), fold(4, 2))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_jaccard_join, op2_quality_rules, op3_token_counts, op4_main_text, op5_substring_dedup, op6_language_scores,
                            op7_decontamination, op8_line_dedup, op9_mixing, op10_toxicity, op11_token_alignment, op12_language_ids, op13_centroid_clusters)
}
ORACLE: dict[str, str] = {"op8_line_dedup": lines.ORACLE, "op9_mixing": mixing.ORACLE, "op13_centroid_clusters": centroids.ORACLE}

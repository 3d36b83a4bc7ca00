"""Corpus pipeline: each stage takes documents and gives the documents that go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.llm.contamination import decontaminate
from shelfspan.llm.jaccard import linked_texts
from shelfspan.llm.lines import line_dedup
from shelfspan.llm.mixing import mix_sources
from shelfspan.llm.quality import quality_rules
from shelfspan.llm.queries import table
from shelfspan.llm.words import row_key
from shelfspan.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", row_key("doc_id", "text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    keyed = _keyed(docs)
    judged = quality_rules(keyed, table(spark, sf_dir, "labels"), carry=("doc_id", "_key"))
    return keyed.join(judged.filter("kept").select("_key").distinct(), "_key", "left_semi").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; ``n_chars`` follows the text."""
    aside = {c: f"_{c}_of_input" for c in ("n_lines", "n_dropped") if c in docs.columns}
    cleared = line_dedup(docs.withColumnsRenamed(aside)).drop("n_lines", "n_dropped")
    back = cleared.withColumnsRenamed({v: k for k, v in aside.items()})
    return back.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; repeated rows once.

    Documents without words are linked with nothing and all stay.
    """
    keyed = _keyed(docs)
    facts, labels = linked_texts(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_key").alias("key")))
    held = facts.select("key", "doc_id").join(labels.distinct(), "key")
    best = held.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best")).select(F.col("best.key").alias("_key"))
    wordless = facts.filter("n = 0").select(F.col("key").alias("_key")).distinct()
    one = keyed.join(best, "_key", "left_semi").dropDuplicates(["_key"])
    return one.unionByName(keyed.join(wordless, "_key", "left_semi")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = _keyed(docs)
    leaked = decontaminate(keyed, table(spark, sf_dir, "benchmark"), key="_key")
    return keyed.join(leaked.select(F.col("key").alias("_key")).distinct(), "_key", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing),
]
#: The trees of the first stage have no SQL form; tests hold what stages keep against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs

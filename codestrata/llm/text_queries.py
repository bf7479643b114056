"""Queries of problems 8, 9 and 10, over the texts of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import mixing, packing, quality
from codestrata.llm.tokens import FOLDER, token_counts
from codestrata.sources.tables import table


def _counted(spark: SparkSession, folder: str, tokenizers: str, *columns: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", *columns).withColumnRenamed("doc_id", "id")
    return token_counts(docs, tokenizers)


def _packed(spark: SparkSession, folder: str, tokenizers: str) -> DataFrame:
    plans = {r["plan"]: r["capacity_tokens"] for r in table(spark, folder, "pack_plans").collect()}  # three rows
    return packing.pack_documents(_counted(spark, folder, tokenizers), plans)


def p8_pack(spark: SparkSession, folder: str, tokenizers: str = FOLDER) -> DataFrame:
    return _packed(spark, folder, tokenizers)


def p8_fill(spark: SparkSession, folder: str, tokenizers: str = FOLDER) -> DataFrame:
    return packing.fill(_packed(spark, folder, tokenizers), table(spark, folder, "pack_plans"))


def p8_steps(spark: SparkSession, folder: str, tokenizers: str = FOLDER) -> DataFrame:
    return packing.steps(_packed(spark, folder, tokenizers))


def p9_mix(spark: SparkSession, folder: str, tokenizers: str = FOLDER) -> DataFrame:
    return mixing.mix(_counted(spark, folder, tokenizers, "source"), table(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str, tokenizers: str = FOLDER) -> DataFrame:
    return mixing.mix(_counted(spark, folder, tokenizers, "source"), table(spark, folder, "mix_targets"))[1]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    shares = quality.label_shares(_documents(spark, folder), table(spark, folder, "common_words"))
    return shares.where("kind is not null").select(F.col("id").alias("doc_id"), "kind")


def p10_labels(spark: SparkSession, folder: str) -> DataFrame:
    return quality.label_shares(_documents(spark, folder), table(spark, folder, "common_words")).withColumnRenamed("id", "doc_id")


def p10_figures(spark: SparkSession, folder: str) -> DataFrame:
    words = sorted({r["word"].lower() for r in table(spark, folder, "common_words").collect() if r["word"]})  # a fixed list
    return quality.figures(_documents(spark, folder), words).withColumnRenamed("id", "doc_id")


QUERIES = {"p8_pack": p8_pack, "p8_fill": p8_fill, "p8_steps": p8_steps, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_labels": p10_labels, "p10_figures": p10_figures}

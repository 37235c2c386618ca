"""Corpus pipeline: toxic and poor documents go, copies and benchmark items go, and texts pass the tokenizer.

Every stage judges each row by its own text: rows with a null or repeated doc_id are judged like any other, null texts
like empty ones. Empty tables give no rows. Extra columns stay in all stages but the last, under whatever name.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgauge.llm import byte_bpe, decontamination, near_dedup, ordinal_quality, toxicity
from shiftgauge.llm.common import new_name, rows_with, stored

#: Documents whose chance of a rating above the lowest is less go.
LEAST_QUALITY = 0.5
RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, stored so that it stays the same, and the name of its column."""
    key = new_name(docs, "row_key")
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut-off, fitted on the labels of all documents given.

    Null and empty texts score 0 and stay. Without labels all documents stay.
    """
    net = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(net, docs["text"].cast("string")) < toxicity.TOXIC_FROM)


def quality_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely to be rated above the lowest grade.

    Null texts are graded as empty ones. Without labels all documents stay.
    """
    model = ordinal_quality.train(docs, _table(spark, sf_dir, "labels"))
    name = new_name(docs, "graded")
    graded = docs.withColumn(name, ordinal_quality.grade_texts(model, docs["text"].cast("string")))
    return graded.filter(ordinal_quality.kept(model, ordinal_quality.KEPT_GRADE, LEAST_QUALITY, name)).drop(name)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id; shingles of five words.

    Of rows with equal doc_ids the first stored stays; null doc_ids come last. Texts without words, null ones too, are
    copies of nothing and stay.
    """
    rows, key = _keyed(docs)
    groups = near_dedup.near_dedup(rows.select(F.col(key).alias("doc_id"), "text"), n=5)
    groups = groups.select(F.col("doc_id").alias("copy_key"), "component_id")
    ids = rows.select(F.col(key).alias("copy_key"), F.col("doc_id").cast("long").alias("copy_id"))
    order = F.struct(F.col("copy_id").isNull().alias("without"), "copy_id", "copy_key")
    left = groups.join(ids, "copy_key").groupBy("component_id").agg(F.min(order).alias("first"))
    left = stored(left.select(F.col("first.copy_key").alias("copy_key")), "originals")
    return rows_with(rows, key, left).drop(key)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Of rows with equal doc_ids only those that contain one go."""
    rows, key = _keyed(docs)
    found = decontamination.contained(rows.select(F.col(key).alias("doc_id"), "text"), _table(spark, sf_dir, "benchmark"))
    gone = stored(found.select(F.col("doc_id").alias("found_key")).distinct(), "contaminated")
    return rows_with(rows, key, gone, among=False).drop(key)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, the digest of the decoded text of every document, and whether decoding gives the text back.

    Null and empty texts have no ids.
    """
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    coded = docs.select("doc_id", "text", byte_bpe.there_and_back(docs["text"].cast("string"), path, pattern).alias("coded"))
    return coded.select("doc_id", "text", "coded.ids", "coded.decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")).alias("exact"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_out),
    ("quality classifier", quality_in),
    ("near-dedup", copies_out),
    ("benchmark decontamination", benchmark_out),
    ("byte-level BPE", tokens),
]

#: The stages are fitted or search by signatures, so SQL cannot state their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written below spark.checkpoint.dir and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

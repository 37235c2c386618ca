"""Every text operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from shiftgauge.llm import (
    byte_bpe,
    decontamination,
    html_text,
    lexical_tree,
    licences,
    merkle_manifest,
    near_dedup,
    oracle,
    ordinal_quality,
    quality_rules,
    quote_links,
    token_files,
    toxicity,
    warc_archive,
)

Query = Callable[[SparkSession, str], DataFrame]


#: Where this package lies; tasks import it from there when nothing else installs it for them.
HOME = str(Path(__file__).resolve().parents[2])


def importable(query: Query) -> Query:
    """The query with HOME on the path of the tasks' Python, which need not start in the folder of the driver."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        environment = spark.sparkContext.environment
        paths = environment.get("PYTHONPATH", "").split(os.pathsep)
        if HOME not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, paths)])
        return query(spark, sf_dir)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


def op4_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.quote_links(table(spark, sf_dir, "conversations"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.ordinal_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), n=2)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, spark)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest_proofs(table(spark, sf_dir, "documents"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_tree.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WARC_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
r AS (SELECT payload_digest AS d, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN response IS NULL OR page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM p LEFT JOIN r ON d = payload_digest AND payload_bytes >= 1000
"""


DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) AS s
       FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) AS s
       FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY 1)
SELECT doc_id, item_id, any_value(item_shingles) AS item_shingles, count(*) AS shared
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(item_shingles)
"""


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "op1_toxicity": op1_toxicity,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_licences": op3_licences,
        "op4_quote_links": op4_quote_links,
        "op5_decontamination": op5_decontamination,
        "op6_ordinal_quality": op6_ordinal_quality,
        "op7_near_dedup": op7_near_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_token_files": op9_token_files,
        "op10_warc_archive": op10_warc_archive,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_html_text": op12_html_text,
        "op13_lexical_search": op13_lexical_search,
        "pipeline": corpus_pipeline.run,
    }
    return {name: importable(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    found = {
        "op5_decontamination": DECONTAMINATION_SQL,
        "op10_warc_archive": WARC_SQL,
        "op11_merkle_manifest": oracle.MERKLE_SQL,
        "op13_lexical_search": oracle.LEXICAL_SQL,
    }
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found

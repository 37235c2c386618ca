"""Text rewrites. They produce new rows; the source table is never edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgauge.functions.paths import stem
from shiftgauge.functions.text import word
from shiftgauge.operators.files import ScanConfig, is_php, is_walked

FIRST_CLASS = word("class") + r"\s+\w+"


def long_tags(content: Column, keep_echo_tags: bool = False) -> Column:
    """Turn short opening tags into long ones, unless the text starts with a long tag.

    By default ``<?=`` becomes ``<?php =`` as well, which does not parse; ``keep_echo_tags``
    leaves it alone.
    """
    pattern = r"<\?(?!php|xml|=)" if keep_echo_tags else r"<\?(?!php|xml)"
    starts_long = F.startswith(content, F.lit("<?php")) | F.startswith(content, F.lit("<?xml"))
    return F.when(starts_long, content).otherwise(F.regexp_replace(content, pattern, "<?php "))


def short_tag_rewrite(files: DataFrame, keep_echo_tags: bool = False) -> DataFrame:
    """Every source file with its rewritten content."""
    new = long_tags(F.col("content"), keep_echo_tags)
    return files.filter(is_php(F.col("path"))).select(
        "project_id", "path", new.alias("content"), (new != F.col("content")).alias("changed")
    )


def first_class_name(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, word("class") + r"\s+(\w+)", 1), F.lit(""))


def renamed_first_class(content: Column, new_name: Column) -> Column:
    start = F.regexp_instr(content, F.lit(FIRST_CLASS))
    size = F.length(F.regexp_substr(content, F.lit(FIRST_CLASS)))
    return F.concat(
        F.substr(content, F.lit(1), start - 1), F.lit("class "), new_name, F.substr(content, start + size)
    )


def class_name_sync(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Files whose first class is not named after the file, with that class renamed."""
    path, content = F.col("path"), F.col("content")
    return (
        files.filter(is_php(path) & is_walked(path, config))
        .withColumn("class_name", first_class_name(content))
        .withColumn("new_name", stem(path))
        .filter(F.col("class_name") != F.col("new_name"))
        .select(
            "project_id", "path", "class_name", "new_name",
            renamed_first_class(content, F.col("new_name")).alias("content"),
        )
    )


def rewritten_files(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Files that long tags and then class names change, with their final content.

    Both rewrites are chained in one projection, so each file is read once.
    """
    path = F.col("path")
    tagged = F.when(is_php(path), long_tags(F.col("content")))
    rewritten = (
        files.filter(is_php(path))
        .select("project_id", "path", F.col("content").alias("old"), tagged.alias("new"))
        .withColumn("class_name", F.when(is_walked(path, config), first_class_name(F.col("new"))))
        .withColumn(
            "new",
            F.when(F.col("class_name") != stem(path), renamed_first_class(F.col("new"), stem(path))).otherwise(
                F.col("new")
            ),
        )
    )
    return rewritten.filter(F.col("old") != F.col("new")).select(
        "project_id", "path", F.col("new").alias("content"), F.lit(True).alias("changed")
    )


def write_rewritten(rewritten: DataFrame, location: str) -> None:
    """Store only what changed. The content is written where it was computed, without a shuffle."""
    rewritten.write.mode("overwrite").parquet(location)

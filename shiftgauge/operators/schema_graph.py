"""Database schemas as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgauge.sources.corpus import schema_columns


def schema_nodes(columns: DataFrame) -> DataFrame:
    """One record label per table. A group is the columns of one table, which databases bound."""
    entry = F.struct("ordinal", F.concat("column_name", F.lit(" : "), "binding_type").alias("text"))
    listed = F.array_sort(F.collect_list(entry))
    return (
        schema_columns(columns)
        .groupBy("project_id", "table_name")
        .agg(listed.alias("entries"))
        .select(
            "project_id",
            "table_name",
            F.concat(
                F.lit("{ "), "table_name", F.lit(" | "),
                F.array_join(F.col("entries.text"), " | "), F.lit(" }"),
            ).alias("label"),
        )
    )


def schema_tables(columns: DataFrame) -> DataFrame:
    return columns.select("project_id", "table_name").distinct()


def foreign_key_edges(columns: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """One edge per foreign key; a key to an unknown table is flagged, not dropped."""
    targets = schema_tables(columns).select(
        "project_id", F.col("table_name").alias("foreign_table"), F.lit(True).alias("known")
    )
    return foreign_keys.join(targets, ["project_id", "foreign_table"], "left").select(
        "project_id", "table_name", "fk_name", "foreign_table", F.col("known").isNull().alias("missing_target")
    )


def schema_summary(columns: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    tables = schema_tables(columns).groupBy("project_id").agg(F.count(F.lit(1)).alias("table_count"))
    edges = foreign_key_edges(columns, foreign_keys).groupBy("project_id").agg(
        F.count_if(~F.col("missing_target")).alias("edge_count"),
        F.count_if("missing_target").alias("missing_count"),
    )
    return tables.join(edges, "project_id", "left").select(
        "project_id",
        "table_count",
        F.coalesce("edge_count", F.lit(0)).alias("edge_count"),
        F.coalesce("missing_count", F.lit(0)).alias("missing_count"),
    )

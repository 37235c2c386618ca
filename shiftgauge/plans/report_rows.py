"""The reports as (metric, score, weight) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.functions.bands import legacy_label
from shiftgauge.operators.scoring import legacy_progress_percent

# Row labels.
MIGRATION_LABELS = {
    "framework_coupling": "Framework Coupling",
    "database_coupling": "Database Coupling",
    "dependency_compatibility": "Dependency Compatibility",
    "architecture": "Architecture Quality",
    "test_coverage": "Test Coverage",
    "codebase_size": "Codebase Size",
}
UPGRADE_LABELS = {
    "framework_version": "Framework Version Upgradability",
    "dependencies": "Dependencies Upgradability",
    "php_version": "PHP Version Upgradability",
    "codebase_size": "Codebase Size Upgradability",
}
NO_DATABASE = "No database layer detected"
OVERALL = "Overall Score"
LEGACY_LABELS = ("Legacy files", "New code files", "Migration progress (by file count)", "Legacy coupling score")


def _row(metric: Column, score: Column, weight: Column, note: Column) -> Column:
    return F.struct(
        metric.alias("metric"),
        score.cast("double").alias("score"),
        weight.cast("int").alias("weight"),
        note.cast("string").alias("note"),
    )


def migration_rows(report: DataFrame) -> DataFrame:
    """Rows of each migration report; the templating and legacy rows appear only if there is data."""
    none = F.lit(None)
    templated = F.col("includes_templating")

    def weight(name: str) -> Column:
        return F.when(templated, F.lit(fixed.MIGRATION_WEIGHTS_WITH_TEMPLATES[name])).otherwise(
            F.lit(fixed.MIGRATION_WEIGHTS[name])
        )

    rows = []
    for name, label in MIGRATION_LABELS.items():
        score, note = F.col(name), none
        if name == "database_coupling":
            score = F.when(F.col("database_detected"), score)
            note = F.when(~F.col("database_detected"), F.lit(NO_DATABASE))
        rows.append(_row(F.lit(label), score, weight(name), note))
    label = F.format_string("Templating (%s, %d files)", F.col("template_engine"), F.col("template_count"))
    rows.append(
        F.when(
            templated,
            _row(label, F.col("templating"), F.lit(fixed.MIGRATION_WEIGHTS_WITH_TEMPLATES["templating"]), none),
        )
    )
    rows.append(_row(F.lit(OVERALL), F.col("total"), none, F.col("band")))
    legacy = [
        (F.col("legacy_count"), none),
        (F.col("file_count"), none),
        (legacy_progress_percent(), none),
        (F.col("legacy_coupling"), legacy_label(F.col("legacy_coupling"))),
    ]
    for label_text, (score, note) in zip(LEGACY_LABELS, legacy, strict=True):
        rows.append(F.when(F.col("legacy_count") > 0, _row(F.lit(label_text), score, none, note)))
    return report.select(
        "project_id",
        F.lit("migration").alias("report"),
        "source_choice",
        F.col("target_framework").alias("target"),
        F.inline(F.array_compact(F.array(*rows))),
    )


def upgrade_rows(report: DataFrame) -> DataFrame:
    none = F.lit(None)
    rows = [
        _row(F.lit(label), F.col(name), F.lit(fixed.UPGRADE_WEIGHTS[name]), none)
        for name, label in UPGRADE_LABELS.items()
    ]
    rows.append(_row(F.lit(OVERALL), F.col("total"), none, F.col("band")))
    return report.filter("has_manifest").select(
        "project_id",
        F.lit("upgrade").alias("report"),
        F.lit(None).cast("string").alias("source_choice"),
        F.col("target_php").alias("target"),
        F.inline(F.array(*rows)),
    )


def report_rows(migration_report: DataFrame, upgrade_report: DataFrame) -> DataFrame:
    return migration_rows(migration_report).unionByName(upgrade_rows(upgrade_report))


def difficulty_bands(migration_report: DataFrame, upgrade_report: DataFrame) -> DataFrame:
    """Projects per band, over the corpus."""
    rows = migration_report.select(
        F.lit("migration").alias("report"), F.col("target_framework").alias("target"), "band"
    ).unionByName(
        upgrade_report.filter("has_manifest").select(F.lit("upgrade").alias("report"), F.col("target_php").alias("target"), "band")
    )
    return rows.groupBy("report", "target", "band").agg(F.count(F.lit(1)).alias("projects"))

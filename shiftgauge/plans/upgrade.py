"""The upgrade report: manifest facts and a file count; no file content is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgauge.functions.bands import upgrade_band
from shiftgauge.operators import dependencies, scoring
from shiftgauge.operators.files import ScanConfig
from shiftgauge.plans import migration
from shiftgauge.sources import corpus as source
from shiftgauge.sources import dims
from shiftgauge.sources.corpus import Corpus


def flagged_projects(corpus: Corpus) -> DataFrame:
    return migration.with_manifests(corpus, corpus.projects).select("project_id", "has_manifest")


def outdated(corpus: Corpus) -> DataFrame:
    packages = corpus.parsed.select("project_id", F.inline("packages"))
    joined = dependencies.dependency_registry_join(packages, source.registry_latest(corpus.registry))
    return dependencies.outdated_dependencies(joined)


def framework_version(corpus: Corpus) -> DataFrame:
    return dependencies.framework_version_upgrade(
        corpus.projects, migration.detected(corpus), dims.runtimes(corpus.projects.sparkSession)
    )


def php_version(corpus: Corpus) -> DataFrame:
    return dependencies.php_version_upgrade(
        migration.with_manifests(corpus, corpus.projects), source.latest_runtime(corpus.releases)
    )


def codebase_size(corpus: Corpus, config: ScanConfig, counted: DataFrame | None = None) -> DataFrame:
    return (migration.tallies(corpus, config) if counted is None else counted).select(
        "project_id", "file_count", scoring.codebase_size_score().alias("codebase_size")
    )


def upgrade_report(corpus: Corpus, config: ScanConfig, counted: DataFrame | None = None) -> DataFrame:
    """Scores, total and band per project and target runtime; null without a manifest.

    counted: the tallies of all projects, where they are known already. One row per project is joined first; the target runtimes multiply it last.
    """
    corpus = corpus.with_shared_manifests()
    facts = migration.with_manifests(corpus, corpus.projects)
    newest = source.latest_runtime(corpus.releases)
    per_project = (
        dependencies.dependency_upgrade(facts, outdated(corpus), "php_version")
        .join(codebase_size(corpus, config, counted), "project_id")
        .transform(lambda rows: dependencies.php_version_upgrade(rows, newest, "outdated_count", "dependencies", "file_count", "codebase_size", "has_manifest"))
        .drop("php_version", "latest_php")
        .withColumnRenamed("php_version_score", "php_version")
    )
    known = F.col("has_manifest")
    scores = ["framework_version", "dependencies", "php_version", "codebase_size"]
    return (
        per_project.join(framework_version(corpus), "project_id")
        .select(
            "project_id", "target_php", "has_manifest", "file_count", "outdated_count",
            *[F.when(known, F.col(s)).alias(s) for s in scores],
        )
        .withColumn("total", scoring.upgrade_total())
        .withColumn("band", upgrade_band(F.col("total")))
    )

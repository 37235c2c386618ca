"""The migration report: one wide scan, one narrow shuffle, then joins of one row per project."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.functions.bands import legacy_label, migration_band
from shiftgauge.operators import dependencies, detection, features, scoring
from shiftgauge.operators.files import ScanConfig
from shiftgauge.sources.corpus import Corpus

Pairs = list[tuple[str | None, str | None]]


def tallies(
    corpus: Corpus, config: ScanConfig, signatures: features.Signatures = fixed.SIGNATURES
) -> DataFrame:
    counted = features.project_tallies(features.file_features(corpus.files, config, signatures), signatures)
    return features.complete_tallies(corpus.projects, counted)


def detected(corpus: Corpus) -> DataFrame:
    return detection.framework_certainty(corpus.parsed, corpus.paths)


def scenarios(corpus: Corpus, pairs: Pairs, project_rows: DataFrame | None = None) -> DataFrame:
    """Scenarios over plain projects, or over project rows that carry more columns."""
    rows = corpus.projects if project_rows is None else project_rows
    return detection.scenario_matrix(detection.with_primary(rows, detected(corpus)), pairs)


def with_manifests(corpus: Corpus, project_rows: DataFrame) -> DataFrame:
    return dependencies.with_manifests(project_rows, corpus.parsed)


def with_engines(corpus: Corpus, config: ScanConfig, project_rows: DataFrame) -> DataFrame:
    engines = features.template_engine_by_ending(corpus.files, config)
    return project_rows.join(engines, "project_id", "left").withColumn("template_engine", scoring.template_engine())


def scored(
    corpus: Corpus,
    config: ScanConfig,
    pairs: Pairs,
    include_templating: bool = True,
    extra_scores: Mapping[str, Callable[[], Column]] | None = None,
    signatures: features.Signatures = fixed.SIGNATURES,
    counted: DataFrame | None = None,
) -> DataFrame:
    """All component scores, total and band per project and scenario.

    counted: the tallies of all projects, where they are known already. Everything is joined at one row per project; the scenarios then multiply finished rows, and
    their scores are expressions on them.
    """
    corpus = corpus.with_shared_manifests()
    if counted is None:
        counted = tallies(corpus, config, signatures)
    scored_projects = scoring.project_scores(counted)
    per_project = with_engines(corpus, config, with_manifests(corpus, scored_projects))
    per_scenario = dependencies.with_dependency_scores(scenarios(corpus, pairs, per_project))
    with_templates = F.lit(include_templating) & (F.col("template_count") > 0)
    scores = per_scenario.withColumns(
        {
            "framework_coupling": scoring.framework_coupling_score(signatures),
            "legacy_coupling": scoring.legacy_coupling_score(signatures),
            "includes_templating": with_templates,
            "templating": F.when(with_templates, scoring.template_score()),
            **{name: build() for name, build in (extra_scores or {}).items()},
        }
    )
    total = scores.withColumn("total", scoring.migration_total(F.col("includes_templating")))
    return total.withColumn("band", migration_band(F.col("total")))


REPORT_COLUMNS = [
    "project_id", "source_choice", "source_framework", "target_framework", "has_manifest", "file_count",
    "framework_coupling", "database_coupling", "database_detected", "dependency_compatibility",
    "architecture", "test_coverage", "codebase_size", "includes_templating", "template_engine",
    "template_count", "templating", "legacy_count", "legacy_coupling", "total", "band",
]


def migration_report(
    corpus: Corpus, config: ScanConfig, pairs: Pairs, include_templating: bool = True, counted: DataFrame | None = None
) -> DataFrame:
    return scored(corpus, config, pairs, include_templating, counted=counted).select(*REPORT_COLUMNS)


def legacy_progress(corpus: Corpus, config: ScanConfig, pairs: Pairs) -> DataFrame:
    """Legacy and new files, progress and legacy coupling; projects without legacy files are left out."""
    with_legacy = tallies(corpus, config).filter(F.col("legacy_count") > 0)
    return (
        scenarios(corpus, pairs, with_legacy)
        .withColumn("legacy_coupling", scoring.legacy_coupling_score())
        .select(
            "project_id", "source_choice", "source_framework", "target_framework", "legacy_count",
            F.col("file_count").alias("new_count"),
            scoring.legacy_progress_percent().alias("progress"),
            "legacy_coupling",
            legacy_label(F.col("legacy_coupling")).alias("label"),
        )
    )

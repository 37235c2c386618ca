"""Scores from tallies. Each is an expression over counts, so a report needs no further scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.operators.dependencies import clamp, round2


Frameworks = Iterable[str]


def by_framework(framework: str, column: str, known: Frameworks = fixed.FRAMEWORKS) -> Column:
    """The tally of the framework that a row's scenario names; null for an unknown framework."""
    branches = " ".join(f"when '{fw}' then {column}_{fw}" for fw in known)
    return F.expr(f"case {framework} {branches} end")


def coupling_score(total: Column, coupled: Column, heavy: Column, source: Column, target: Column) -> Column:
    """Exponential decay over the shares of coupled and heavily coupled files."""
    impact = coupled / F.nullif(total, F.lit(0)) * 0.6 + heavy / F.nullif(total, F.lit(0)) * 0.4
    irrelevant = (total == 0) | F.coalesce(source == target, F.lit(False)) | coupled.isNull()
    return F.when(irrelevant, F.lit(100.0)).otherwise(round2(clamp(F.exp(impact * -4.0) * 100.0)))


def framework_coupling_score(known: Frameworks = fixed.FRAMEWORKS) -> Column:
    source = "source_framework"
    return coupling_score(
        F.col("file_count"),
        by_framework(source, "coupled", known),
        by_framework(source, "heavy", known),
        F.col(source),
        F.col("target_framework"),
    )


def legacy_coupling_score(known: Frameworks = fixed.FRAMEWORKS) -> Column:
    """The same score over the legacy files; null without any."""
    source = "source_framework"
    score = coupling_score(
        F.col("legacy_count"),
        by_framework(source, "legacy_coupled", known),
        by_framework(source, "legacy_heavy", known),
        F.col(source),
        F.col("target_framework"),
    )
    return F.when(F.col("legacy_count") > 0, score)


def database_detected() -> Column:
    return (F.col("db_eloquent") + F.col("db_doctrine") + F.col("db_active_record") + F.col("db_raw")) > 0


def database_coupling_score() -> Column:
    """The first rule that fits decides; the order of the rules matters."""
    eloquent, doctrine = F.col("db_eloquent"), F.col("db_doctrine")
    active_record, raw = F.col("db_active_record"), F.col("db_raw")
    total = F.nullif(F.col("file_count"), F.lit(0))
    raw_share = raw / total
    no_mapper = (eloquent == 0) & (doctrine == 0)
    return (
        F.when(~database_detected(), F.lit(100.0))
        .when((doctrine > 0) & (eloquent + active_record + raw == 0), F.lit(70.0))
        .when(
            (active_record > 0) & no_mapper,
            round2(F.greatest(F.lit(5.0), F.lit(50.0) - active_record / total * 250.0 - raw_share * 50.0)),
        )
        .when((raw > 0) & no_mapper, round2(F.greatest(F.lit(20.0), F.lit(80.0) - raw_share * 60.0)))
        .otherwise(round2(F.greatest(F.lit(10.0), F.lit(50.0) - eloquent / total * 35.0 - raw_share * 15.0)))
    )


def architecture_score() -> Column:
    total = F.nullif(F.col("file_count"), F.lit(0))

    def part(flag: str, most: float, factor: float) -> Column:
        return F.least(F.lit(most), F.col(f"n_{flag}") / total * factor)

    points = (
        part("is_service", 25.0, 250.0)
        + part("is_repository", 20.0, 200.0)
        + part("has_interface", 20.0, 100.0)
        + part("has_injection", 20.0, 80.0)
        + part("is_orm_entity", 15.0, 300.0)
    )
    return F.when(total.isNull(), F.lit(50.0)).otherwise(round2(points))


def test_coverage_score() -> Column:
    total, tests = F.nullif(F.col("file_count"), F.lit(0)), F.nullif(F.col("n_is_test"), F.lit(0))
    independent = (tests - F.col("n_is_coupled_test")) / tests
    points = F.least(F.lit(70.0), tests / total * 140.0) + independent * 30.0
    return F.when(total.isNull() | tests.isNull(), F.lit(0.0)).otherwise(
        round2(F.least(F.lit(100.0), points))
    )


def codebase_size_score() -> Column:
    total = F.col("file_count")
    size = F.lit(200.0) - F.log10(F.nullif(total, F.lit(0)).cast("double")) * 45.0
    return F.when(total == 0, F.lit(100.0)).otherwise(round2(clamp(size, 5.0)))


def template_engine() -> Column:
    return F.coalesce(
        "file_engine",
        "manifest_engine",
        F.when(F.col("template_count") > 0, F.lit("php")).otherwise(F.lit("none")),
    )


def template_score() -> Column:
    engine, target = F.col("template_engine"), F.col("target_framework")
    twig = (
        F.when(target == "symfony", F.lit(95.0))
        .when(target.isin("laravel", "tempest"), F.lit(70.0))
        .otherwise(F.lit(60.0))
    )
    blade = F.when(target == "laravel", F.lit(95.0)).otherwise(F.lit(25.0))
    mean = F.col("signals") / F.nullif(F.col("template_count"), F.lit(0)) / 20.0
    php = round2(F.greatest(F.lit(15.0), F.lit(70.0) - mean * 55.0))
    return (
        F.when(engine == "twig", twig)
        .when(engine == "blade", blade)
        .when(engine == "volt", F.lit(20.0))
        .when(engine == "smarty", F.lit(50.0))
        .when(engine == "php", php)
        .otherwise(F.lit(100.0))
    )


def weighted_total(weights: dict[str, int]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name) * weight / 100
    return round2(total)


def migration_total(with_templates: Column) -> Column:
    return F.when(with_templates, weighted_total(fixed.MIGRATION_WEIGHTS_WITH_TEMPLATES)).otherwise(
        weighted_total(fixed.MIGRATION_WEIGHTS)
    )


def upgrade_total() -> Column:
    return weighted_total(fixed.UPGRADE_WEIGHTS)


def legacy_progress_percent() -> Column:
    new, legacy = F.col("file_count"), F.col("legacy_count")
    return F.when(legacy > 0, round2(new / F.nullif(new + legacy, F.lit(0)) * 100, 1))


def project_scores(tallies: DataFrame) -> DataFrame:
    """The scores that depend on the project alone."""
    return tallies.withColumns(
        {
            "database_detected": database_detected(),
            "database_coupling": database_coupling_score(),
            "architecture": architecture_score(),
            "test_coverage": test_coverage_score(),
            "codebase_size": codebase_size_score(),
        }
    )

"""Every operator over the derived corpus, under the name of the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgauge.operators import dependencies, detection, features, files, inventories, pattern_tables, rewrites, schema_graph, scoring
from shiftgauge.operators.files import ScanConfig
from shiftgauge.plans import migration, report_rows, upgrade
from shiftgauge.sources import corpus as source
from shiftgauge.sources import dims
from shiftgauge.sources.corpus import Corpus
from shiftgauge.sources.fixtures import load_corpus

Query = Callable[[SparkSession, str], DataFrame]

CONFIG = ScanConfig(exclude=("vendor", "node_modules", "var"), legacy_dirs=("system/cms", "system"))
PLAIN = ScanConfig(exclude=CONFIG.exclude)
PAIRS: migration.Pairs = [
    *[(None, target) for target in ("symfony", "laravel", "codeigniter", "yii", "zend", "cakephp", "phalcon", "tempest")],
    ("codeigniter", "symfony"),
    ("laravel", "none"),
    ("phalcon", "laravel"),
    ("none", "symfony"),
]


def _packages(c: Corpus) -> DataFrame:
    return source.manifest_packages(c.manifests)


def _parsed(c: Corpus) -> DataFrame:
    return source.parsed_manifests(c.manifests)


def _score(c: Corpus, *columns: str | F.Column) -> DataFrame:
    return scoring.project_scores(migration.tallies(c, CONFIG)).select("project_id", *columns)


def _scenario_score(c: Corpus, *columns: str) -> DataFrame:
    return migration.scored(c, CONFIG, PAIRS).select("project_id", "source_choice", "target_framework", *columns)


def _framework_coupling(c: Corpus) -> DataFrame:
    return migration.scenarios(c, PAIRS, migration.tallies(c, CONFIG)).select(
        "project_id", "source_choice", "source_framework", "target_framework",
        scoring.framework_coupling_score().alias("framework_coupling"),
    )


def _dependency_scores(c: Corpus, *columns: str) -> DataFrame:
    scenarios = migration.scenarios(c, PAIRS, migration.with_manifests(c, c.projects))
    return dependencies.with_dependency_scores(scenarios).select(
        "project_id", "source_choice", "source_framework", "target_framework", *columns
    )


def _templates(c: Corpus) -> DataFrame:
    return migration.with_engines(c, CONFIG, migration.with_manifests(c, migration.tallies(c, CONFIG)))


def _template_score(c: Corpus) -> DataFrame:
    targets = dims.options(c.projects.sparkSession, [(None, t) for t in sorted({t for _, t in PAIRS})])
    return (
        _templates(c)
        .crossJoin(targets)
        .select("project_id", "target_framework", "template_engine", scoring.template_score().alias("templating"))
    )


def _registry_join(c: Corpus) -> DataFrame:
    return dependencies.dependency_registry_join(_packages(c), source.registry_latest(c.registry))


def _version_order(c: Corpus) -> DataFrame:
    return dependencies.version_order(c.registry).select(
        "name", "version", F.array_join("version_key", ".").alias("version_key")
    )


def _incompatible(c: Corpus) -> DataFrame:
    return dependencies.incompatible_packages(_parsed(c), migration.scenarios(c, PAIRS))


def _migration_report(c: Corpus) -> DataFrame:
    return migration.migration_report(c, CONFIG, PAIRS)


def _upgrade_report(c: Corpus) -> DataFrame:
    return upgrade.upgrade_report(c, CONFIG)


OPERATORS: dict[str, Callable[[Corpus], DataFrame]] = {
    # Scans and sources
    "scan_code_files": lambda c: files.scan_code_files(c.files, CONFIG),
    "exclude_dirs": lambda c: files.exclude_dirs(c.files, CONFIG),
    "legacy_split": lambda c: files.legacy_split(c.files, CONFIG),
    "template_files": lambda c: files.template_files(c.files, CONFIG),
    "manifest_packages": _packages,
    "registry_latest": lambda c: source.registry_latest(c.registry),
    "latest_runtime": lambda c: source.latest_runtime(c.releases),
    "schema_columns": lambda c: source.schema_columns(c.columns),
    # Sinks
    "routes_dump": lambda c: inventories.routes_dump(inventories.routes(c.files, PLAIN)),
    "report_rows": lambda c: report_rows.report_rows(_migration_report(c), _upgrade_report(c)),
    "rewritten_files": lambda c: rewrites.rewritten_files(c.files, PLAIN),
    # Projections, filters, pattern counts
    "signature_counts": lambda c: features.signature_counts(c.files, CONFIG),
    "signature_hits_by_kind": lambda c: features.signature_hits_by_kind(c.files, CONFIG),
    "database_file_class": lambda c: features.database_file_class(c.files, CONFIG),
    "architecture_flags": lambda c: features.listed_flags(c.files, CONFIG, features.ARCHITECTURE_FLAGS),
    "test_file_flags": lambda c: features.listed_flags(c.files, CONFIG, features.TEST_FLAGS),
    "template_spaghetti": lambda c: features.template_spaghetti(c.files, CONFIG),
    "version_parts": lambda c: dependencies.version_parts(_packages(c)),
    "unstable_constraints": lambda c: detection.unstable_constraints(_packages(c)),
    # Joins
    "package_catalogue_join": lambda c: detection.package_catalogue_join(_parsed(c)),
    "fingerprint_match": lambda c: detection.fingerprint_match(c.paths),
    "prefix_package_match": lambda c: dependencies.prefix_package_match(_packages(c)),
    "incompatible_packages": _incompatible,
    "target_version_lookup": lambda c: dependencies.target_version_lookup(
        migration.detected(c), dims.runtimes(c.projects.sparkSession)
    ),
    "dependency_registry_join": _registry_join,
    "foreign_key_edges": lambda c: schema_graph.foreign_key_edges(c.columns, c.foreign_keys),
    "scenario_matrix": lambda c: migration.scenarios(c, PAIRS),
    # Aggregations and scores
    "framework_certainty": migration.detected,
    "framework_coupling": _framework_coupling,
    "database_coupling": lambda c: _score(c, "database_coupling", "database_detected"),
    "dependency_compatibility": lambda c: _dependency_scores(c, "dependency_compatibility"),
    "php_version_penalty": lambda c: _dependency_scores(c, "php_version", "php_penalty"),
    "architecture_score": lambda c: _score(c, "architecture"),
    "test_coverage": lambda c: _score(c, "test_coverage"),
    "codebase_size": lambda c: upgrade.codebase_size(c, CONFIG),
    "template_engine": lambda c: _templates(c).select("project_id", "template_engine"),
    "template_count": lambda c: _score(c, "template_count"),
    "template_score": _template_score,
    "dependency_upgrade": lambda c: dependencies.dependency_upgrade(upgrade.flagged_projects(c), upgrade.outdated(c)),
    "outdated_dependencies": upgrade.outdated,
    "php_version_upgrade": upgrade.php_version,
    "framework_version_upgrade": upgrade.framework_version,
    "migration_total": lambda c: _scenario_score(c, "includes_templating", "total"),
    "upgrade_total": lambda c: _upgrade_report(c).select("project_id", "target_php", "total"),
    "difficulty_bands": lambda c: report_rows.difficulty_bands(_migration_report(c), _upgrade_report(c)),
    "legacy_progress": lambda c: migration.legacy_progress(c, CONFIG, PAIRS),
    "mixed_codebase": lambda c: detection.mixed_codebase(c.projects, migration.detected(c)),
    # First, last and arg-max
    "primary_framework": lambda c: detection.primary_framework(migration.detected(c)),
    "representative_package": lambda c: detection.representative_package(
        detection.package_catalogue_join(_parsed(c))
    ),
    "first_php_package": lambda c: dependencies.first_php_package(_parsed(c)),
    # Order and set operations
    "version_order": _version_order,
    "all_packages": lambda c: source.all_packages(_packages(c)),
    "directory_order": lambda c: inventories.directory_order(c.files, PLAIN),
    # Inventories, plans and rewrites
    "routes": lambda c: inventories.routes(c.files, PLAIN),
    "route_count": lambda c: inventories.route_count(inventories.routes(c.files, PLAIN)),
    "short_tag_rewrite": lambda c: rewrites.short_tag_rewrite(c.files),
    "multi_class_census": lambda c: inventories.multi_class_census(c.files, PLAIN),
    "class_split_plan": lambda c: inventories.class_split_plan(c.files, PLAIN),
    "class_name_sync": lambda c: rewrites.class_name_sync(c.files, PLAIN),
    "braceless_if_census": lambda c: inventories.braceless_if_census(c.files),
    "directory_rename_plan": lambda c: inventories.directory_rename_plan(c.files, c.paths, PLAIN),
    "directory_capitalise_plan": lambda c: inventories.directory_capitalise_plan(c.paths, PLAIN),
    "camel_case": lambda c: inventories.names(c.files, PLAIN),
    "namespace_map": lambda c: inventories.namespace_map(c.files, PLAIN),
    "schema_nodes": lambda c: schema_graph.schema_nodes(c.columns),
    "schema_summary": lambda c: schema_graph.schema_summary(c.columns, c.foreign_keys),
    # Composite reports
    "migration_report": _migration_report,
    "upgrade_report": _upgrade_report,
}


def _over_corpus(operator: Callable[[Corpus], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(load_corpus(spark, sf_dir))

    return run


def pack_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack out of a table: the longer words of the benchmark items, looked up in all listed files."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    word = F.explode(F.split("text", "[^a-z]+")).alias("literal")
    pack = items.select(F.concat(F.lit("pack-"), F.col("item_id") % 7).alias("framework"), word).filter("length(literal) >= 5")
    return pattern_tables.pack_counts(load_corpus(spark, sf_dir).files, pack, CONFIG)


def prefix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the registry and the manifests against the vendors and shortened names that they have."""
    c = load_corpus(spark, sf_dir)
    names = c.registry.select("name").unionByName(_packages(c).select("name"))
    vendor = F.substring_index("name", "/", 1)
    owned = [F.struct(F.concat(vendor, F.lit("/")).alias("prefix"), vendor.alias("owner")),
             F.struct(F.expr("left(name, length(name) - 2)").alias("prefix"), F.col("name").alias("owner"))]
    return pattern_tables.prefix_matches(names, names.select(F.inline(F.array(*owned))))


#: Queries whose further tables come straight from the given ones.
TABLES: dict[str, Query] = {"pack_counts": pack_counts, "prefix_matches": prefix_matches}


def queries() -> dict[str, Query]:
    return {name: _over_corpus(operator) for name, operator in OPERATORS.items()} | TABLES

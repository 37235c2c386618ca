"""Package compatibility, runtime gaps and outdated dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.functions.text import sql_literal
from shiftgauge.functions.versions import major, minor, version_key
from shiftgauge.operators.joins import HOT_ROWS, salted_lookup
from shiftgauge.sources import dims


def round2(score: Column, digits: int = 2) -> Column:
    """Half-up rounding of the decimal value; the inner round drops noise such as 58.254999999999995."""
    return F.round(F.round(score, 10), digits)


def clamp(score: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), score))


def version_parts(packages: DataFrame) -> DataFrame:
    version = F.col("version_string")
    return packages.select(
        "project_id", "ord", "name", "version_string", major(version).alias("major"), minor(version).alias("minor")
    )


def version_order(registry: DataFrame) -> DataFrame:
    """All releases of every package in version order, oldest first; repeated ones stay.

    The sort is global by range, so a package with very many releases spreads over tasks.
    """
    keyed = registry.select("name", "version", version_key("version").alias("version_key"))
    return keyed.orderBy("name", "version_key", "version")


def _owners(name: str) -> str:
    """SQL for the frameworks that own a package name, as an array."""
    terms = []
    for fw in fixed.FRAMEWORKS:
        owned = " or ".join(f"startswith({name}, {sql_literal(x)})" for x in fixed.PACKAGE_PREFIXES[fw])
        terms.append(f"if({owned}, '{fw}', null)")
    return f"array_compact(array({', '.join(terms)}))"


def prefix_package_match(packages: DataFrame) -> DataFrame:
    """Manifest entries that belong to a framework by a name prefix, decided inside the entry's row."""
    return packages.select("project_id", "ord", "name", F.explode(F.expr(_owners("name"))).alias("framework"))


def incompatible_packages(parsed: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Entries that belong to the source framework and not to the target.

    The entries of a manifest stay in its row until a scenario of the project has picked its own.
    """
    owned = parsed.select(
        "project_id",
        F.expr(f"transform(packages, p -> struct(p.ord as ord, p.name as name, {_owners('p.name')} as owners))").alias("entries"),
    )
    pairs = scenarios.select("project_id", "source_framework", "target_framework").distinct()
    picked = F.expr(
        "filter(entries, e -> array_contains(e.owners, source_framework)"
        " and not coalesce(array_contains(e.owners, target_framework), false))"
    )
    return (
        pairs.join(owned, "project_id")
        .select("project_id", "source_framework", "target_framework", F.explode(picked).alias("e"))
        .select("project_id", "source_framework", "target_framework", "e.ord", "e.name")
    )


def _first_php() -> Column:
    return F.expr("get(filter(packages, p -> p.section = 'require' and contains(p.name, 'php')), 0)")


def first_php_package(parsed: DataFrame) -> DataFrame:
    """First required package whose name contains ``php``, which need not be ``php`` itself."""
    return (
        parsed.select("project_id", _first_php().alias("p"))
        .filter(F.col("p").isNotNull())
        .select(
            "project_id",
            F.col("p.name").alias("php_package"),
            F.col("p.version_string").alias("php_version"),
        )
    )


def _owner_mask(name: str) -> str:
    """SQL for the set of frameworks that own a package name, as a bit mask."""
    terms = []
    for bit, fw in enumerate(fixed.FRAMEWORKS):
        owned = " or ".join(f"startswith({name}, {sql_literal(x)})" for x in fixed.PACKAGE_PREFIXES[fw])
        terms.append(f"if({owned}, {1 << bit}, 0)")
    return " + ".join(terms)


def manifest_features(parsed: DataFrame) -> DataFrame:
    """Manifest facts that the migration scores need, row by row.

    ``owners`` holds one framework mask per entry, so any number of scenarios is answered later
    without going back to the packages.
    """
    engines = " ".join(
        f"when startswith(p.name, {sql_literal(x)}) then '{e}'" for x, e in fixed.TEMPLATE_PACKAGES.items()
    )
    required = "filter(packages, p -> p.section = 'require')"
    return parsed.select(
        "project_id",
        # Asked of the packages, so that all readers of a shared manifest need the same columns.
        F.col("packages").isNotNull().alias("manifest_found"),
        F.size("packages").alias("package_count"),
        F.expr(f"transform(packages, p -> {_owner_mask('p.name')})").alias("owners"),
        _first_php()["version_string"].alias("php_version"),
        F.expr(
            f"get(array_compact(transform({required}, p -> case {engines} end)), 0)"
        ).alias("manifest_engine"),
    )


def with_manifests(projects: DataFrame, parsed: DataFrame) -> DataFrame:
    """Project rows with manifest facts; ``has_manifest`` tells a missing manifest from an empty one."""
    joined = projects.join(manifest_features(parsed), "project_id", "left")
    return joined.withColumn("has_manifest", F.coalesce("manifest_found", F.lit(False))).drop("manifest_found")


def incompatible_count(owners: str, source: str, target: str) -> Column:
    """Entries owned by the source and not by the target."""

    def bit(framework: str) -> str:
        branches = " ".join(f"when '{fw}' then {1 << i}" for i, fw in enumerate(fixed.FRAMEWORKS))
        return f"(case {framework} {branches} else 0 end)"

    return F.expr(
        f"size(filter({owners}, mask -> (mask & {bit(source)}) != 0 and (mask & {bit(target)}) = 0))"
    )


def runtime_penalty(version: Column, min_major: Column, min_minor: Column) -> Column:
    """Points lost for the gap between the manifest's runtime and the target's minimum."""
    major_gap = F.greatest(F.lit(0).cast("bigint"), min_major - major(version))
    minor_gap = F.greatest(F.lit(0).cast("bigint"), min_minor - minor(version))
    penalty = F.when(major_gap == 0, F.least(F.lit(30.0), minor_gap * 5.0)).otherwise(
        F.least(F.lit(50.0), major_gap * 25.0 + min_minor * 5.0)
    )
    return F.when(version.isNull() | min_major.isNull(), F.lit(0.0)).otherwise(penalty)


def dependency_compatibility_score(
    has_manifest: Column, package_count: Column, incompatible: Column, penalty: Column
) -> Column:
    total = F.coalesce(package_count, F.lit(0))
    share = F.lit(1.0) - F.coalesce(incompatible, F.lit(0)) / F.nullif(total, F.lit(0))
    return (
        F.when(~has_manifest, F.lit(50.0))
        .when(total == 0, F.lit(100.0))
        .otherwise(round2(clamp(share * 100.0 - penalty)))
    )


def with_dependency_scores(scenarios: DataFrame) -> DataFrame:
    """Scenario rows with the runtime penalty and the dependency score."""
    minimum = dims.minimum_runtime(scenarios.sparkSession)
    penalty = runtime_penalty(F.col("php_version"), F.col("min_major"), F.col("min_minor"))
    incompatible = incompatible_count("owners", "source_framework", "target_framework")
    with_penalty = scenarios.join(minimum, "target_framework", "left").withColumn("php_penalty", penalty)
    return with_penalty.withColumn(
        "dependency_compatibility",
        dependency_compatibility_score(
            F.col("has_manifest"), F.col("package_count"), incompatible, F.col("php_penalty")
        ),
    ).drop("min_major", "min_minor")


def dependency_registry_join(packages: DataFrame, latest: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Required packages with their newest release.

    A name that is itself a part of ``php`` is skipped, as are entries without a version. Packages with
    more than ``hot_rows`` entries are spread over several tasks.
    """
    wanted = packages.filter(
        (F.col("section") == "require")
        & ~F.contains(F.lit("php"), F.col("name"))
        & F.col("version_string").isNotNull()
    )
    return (
        salted_lookup(wanted, latest, key="name", spread="project_id", hot_rows=hot_rows)
        .filter(F.col("latest_version").isNotNull())
        .select("project_id", "ord", "name", "version_string", "latest_version")
    )


def outdated_dependencies(joined: DataFrame) -> DataFrame:
    """Required packages that are older than their newest release."""
    current, latest = F.col("version_string"), F.col("latest_version")
    return joined.filter(version_key("version_string") < version_key("latest_version")).select(
        "project_id",
        "name",
        current.alias("current_version"),
        "latest_version",
        F.abs(major(latest) - major(current)).alias("major_gap"),
    )


def dependency_upgrade(projects: DataFrame, outdated: DataFrame, *kept: str) -> DataFrame:
    """100 less ten points per major version that the outdated packages lag on average. `kept` columns of projects stay."""
    gaps = outdated.groupBy("project_id").agg(
        F.sum("major_gap").alias("gap"), F.count(F.lit(1)).alias("outdated_count")
    )
    lag = F.col("gap") / (F.col("outdated_count") * 10) * 100.0
    score = F.when(F.col("outdated_count").isNull(), F.lit(100.0)).otherwise(round2(clamp(F.lit(100.0) - lag)))
    return projects.join(gaps, "project_id", "left").select(
        "project_id",
        F.coalesce("outdated_count", F.lit(0)).alias("outdated_count"),
        F.when(F.col("has_manifest"), score).alias("dependencies"),
        *(["has_manifest", *kept] if kept else []),
    )


def php_version_upgrade(projects: DataFrame, latest: DataFrame, *kept: str) -> DataFrame:
    """Steps from the manifest's runtime to the newest one; ``latest`` has exactly one row. `kept` columns of projects stay."""
    current, newest = F.col("php_version"), F.col("latest_php")
    steps = F.abs(major(newest) - major(current)) * 5 + F.abs(minor(newest) - minor(current))
    score = F.when(current.isNull(), F.lit(0.0)).otherwise(round2(clamp(F.lit(100.0) - steps * 7)))
    return (
        projects.crossJoin(F.broadcast(latest))
        .select("project_id", "php_version", "latest_php", F.when(F.col("has_manifest"), score).alias("php_version_score"), *kept)
    )


def target_version_lookup(detected: DataFrame, runtimes: DataFrame) -> DataFrame:
    """Version of each detected framework that fits each target runtime; null if none is known."""
    return (
        detected.crossJoin(runtimes)
        .join(dims.target_versions(detected.sparkSession), ["framework", "target_php"], "left")
        .select("project_id", "framework", "version_string", "target_php", "target_version")
    )


def framework_gap_score(framework: Column, version: Column, target: Column) -> Column:
    gap = F.abs(major(target) - major(version)) * 50 + F.abs(minor(target) - minor(version)) * 2
    lost = F.least(F.lit(100.0), F.round(F.log(F.lit(1) + gap) / F.log(F.lit(3.0)) * 5))
    penalty = F.lit(0)
    for name, points in fixed.EXTENSION_PENALTY.items():
        penalty = F.when(framework == name, F.lit(points)).otherwise(penalty)
    return F.when(version.isNull() | target.isNull(), F.lit(100.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(100.0) - lost - penalty)
    )


def framework_version_upgrade(projects: DataFrame, detected: DataFrame, runtimes: DataFrame) -> DataFrame:
    """Mean score over the detected frameworks per project and target runtime."""
    scores = (
        target_version_lookup(detected, runtimes)
        .groupBy("project_id", "target_php")
        .agg(
            F.sum(
                framework_gap_score(F.col("framework"), F.col("version_string"), F.col("target_version")).cast("bigint")
            ).alias("points"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return (
        projects.crossJoin(runtimes)
        .join(scores, ["project_id", "target_php"], "left")
        .select(
            "project_id",
            "target_php",
            F.when(F.col("n").isNull(), F.lit(100.0)).otherwise(round2(F.col("points") / F.col("n"))).alias(
                "framework_version"
            ),
        )
    )

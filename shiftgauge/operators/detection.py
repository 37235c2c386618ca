"""Which frameworks a project uses, from weighted packages and known paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.functions.text import sql_literal
from shiftgauge.functions.versions import is_unstable
from shiftgauge.sources import dims


def package_catalogue_join(parsed: DataFrame) -> DataFrame:
    """Manifest packages that the catalogue knows; the first entry of a name counts.

    The manifest row is cut to known names before it is exploded, and the first entries are found
    inside the row, so the broadcast join needs no shuffle.
    """
    names = ", ".join(sql_literal(name) for found in fixed.CATALOGUE.values() for name, _ in found)
    first = "not exists(packages, q -> q.name = p.name and q.ord < p.ord)"
    return (
        parsed.select("project_id", F.expr(f"filter(packages, p -> p.name in ({names}))").alias("packages"))
        .select("project_id", F.expr(f"inline(filter(packages, p -> {first}))"))
        .join(dims.catalogue(parsed.sparkSession), "name")
        .select(
            "project_id", "framework", "fw_ord", "name", "is_primary", "weight", "sub_ord", "version_string", "ord"
        )
    )


def unstable_constraints(packages: DataFrame) -> DataFrame:
    """Weight multiplier of every manifest entry."""
    unstable = is_unstable(F.col("version_string"))
    return packages.select(
        "project_id", "ord", "name", "version_string",
        unstable.alias("unstable"),
        F.when(unstable, F.lit(0.5)).otherwise(F.lit(1.0)).alias("multiplier"),
    )


def _path_hits(paths: DataFrame) -> DataFrame:
    """One row per path and fingerprint at or above it.

    Every path is cut to its first few segments and looked up in the broadcast dimension, so
    almost all rows end on the map side.
    """
    cuts = F.array_distinct(
        F.array(*[F.substring_index("path", "/", n + 1) for n in range(dims.fingerprint_depth())])
    )
    return paths.select("project_id", F.explode(cuts).alias("fingerprint")).join(
        dims.fingerprints(paths.sparkSession), "fingerprint"
    )


def fingerprint_match(paths: DataFrame) -> DataFrame:
    """Known paths that exist, as a file or as a directory; excludes do not matter here."""
    return _path_hits(paths).select("project_id", "framework", "fw_ord", "fingerprint").distinct()


def representative_package(catalogue_rows: DataFrame) -> DataFrame:
    """The package that stands for a framework: the primary one, else the first in the catalogue."""
    return (
        catalogue_rows.groupBy("project_id", "framework", "fw_ord")
        .agg(F.min_by(F.struct("name", "version_string"), "sub_ord").alias("p"))
        .select(
            "project_id", "framework", "fw_ord",
            F.col("p.name").alias("name"),
            F.col("p.version_string").alias("version_string"),
        )
    )


def framework_certainty(parsed: DataFrame, paths: DataFrame) -> DataFrame:
    """Detected frameworks with certainty, version and rank.

    ``fw_rank`` orders a project's frameworks: found by package first, then by path alone, each in
    catalogue order.
    """
    known = package_catalogue_join(parsed)
    multiplier = F.when(is_unstable(F.col("version_string")), F.lit(0.5)).otherwise(F.lit(1.0))
    by_package = known.groupBy("project_id", "framework", "fw_ord").agg(
        F.least(F.lit(100), F.sum(F.round(F.col("weight") * multiplier).cast("int"))).alias("package_points"),
        F.min_by(F.struct("name", "version_string"), "sub_ord").alias("p"),
    )
    by_path = _path_hits(paths).groupBy("project_id", "framework", "fw_ord").agg(
        F.bit_count(F.bit_or("path_bit")).alias("path_hits")
    )
    joined = by_package.join(by_path, ["project_id", "framework", "fw_ord"], "full")
    path_only = F.col("package_points").isNull()
    hits = F.coalesce("path_hits", F.lit(0))
    points = F.when(path_only, hits * fixed.FINGERPRINT_ALONE).otherwise(
        F.col("package_points") + hits * fixed.FINGERPRINT_BONUS
    )
    return (
        joined.select(
            "project_id",
            "framework",
            F.when(path_only, F.col("framework")).otherwise(F.col("p.name")).alias("name"),
            F.col("p.version_string").alias("version_string"),
            F.least(F.lit(100), points).cast("double").alias("certainty"),
            (F.col("fw_ord") + F.when(path_only, F.lit(len(fixed.FRAMEWORKS))).otherwise(F.lit(0))).alias("fw_rank"),
        )
        .filter(F.col("certainty") >= fixed.MIN_CERTAINTY)
    )


def primary_framework(detected: DataFrame) -> DataFrame:
    """The most certain framework of a project; the lowest rank wins a tie."""
    best = F.max_by(
        F.struct("framework", "name", "version_string", "certainty"),
        F.struct(F.col("certainty"), -F.col("fw_rank")),
    )
    return detected.groupBy("project_id").agg(best.alias("b")).select(
        "project_id",
        F.col("b.framework").alias("primary_framework"),
        F.col("b.name").alias("name"),
        F.col("b.version_string").alias("version_string"),
        F.col("b.certainty").alias("certainty"),
    )


def mixed_codebase(projects: DataFrame, detected: DataFrame) -> DataFrame:
    counts = detected.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return projects.join(counts, "project_id", "left").select(
        "project_id", n.alias("framework_count"), (n > 1).alias("is_mixed")
    )


def with_primary(projects: DataFrame, detected: DataFrame) -> DataFrame:
    primary = primary_framework(detected).select("project_id", "primary_framework")
    return projects.join(primary, "project_id", "left")


def scenario_matrix(with_primary: DataFrame, pairs: list[tuple[str | None, str | None]]) -> DataFrame:
    """Every project row with every (source, target) pair.

    The source falls back to the detected framework, then to ``none``. The pairs come from a list,
    so their number is checked when they are broadcast.
    """
    chosen = dims.options(with_primary.sparkSession, pairs)
    return with_primary.crossJoin(chosen).select(
        *[c for c in with_primary.columns if c != "primary_framework"],
        F.coalesce("chosen_source", F.lit("detected")).alias("source_choice"),
        F.coalesce("chosen_source", "primary_framework", F.lit("none")).alias("source_framework"),
        "target_framework",
    )

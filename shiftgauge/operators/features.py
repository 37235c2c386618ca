"""Per-file features, and the per-project tallies that every score is computed from.

All features come out of one projection over the content; only numbers and flags leave it. A new
feature is a function ``(content, path) -> Column`` and needs no change here (see ``extra``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.functions.text import (
    WORD_END,
    LiteralScanner,
    contains_any,
    ends_with_any,
    line_count,
    occurrences,
    word,
)
from shiftgauge.operators.files import ScanConfig, in_template_list, is_listed, legacy_times

Feature = Callable[[Column, Column], Column]
Signatures = Mapping[str, Mapping[str, list[str]]]

DB_CLASSES = ("eloquent", "doctrine", "active_record", "raw")


def pack_literals(signatures: Signatures, framework: str) -> list[str]:
    return [literal for kind in signatures[framework].values() for literal in kind]


def scanner_for(signatures: Signatures) -> LiteralScanner:
    return LiteralScanner(x for framework in signatures for x in pack_literals(signatures, framework))


def signature_counts(files: DataFrame, config: ScanConfig, signatures: Signatures = fixed.SIGNATURES) -> DataFrame:
    """Hits per file and framework, for all frameworks in one pass over the content."""
    scanner = scanner_for(signatures)
    hits = F.array(
        *[
            F.struct(F.lit(fw).alias("framework"), scanner.count(pack_literals(signatures, fw)).alias("hits"))
            for fw in signatures
        ]
    )
    return (
        files.filter(is_listed(F.col("path"), config))
        .select("project_id", "path", "content", *scanner.columns())
        .select("project_id", "path", F.inline(hits))
    )


def signature_hits_by_kind(
    files: DataFrame, config: ScanConfig, signatures: Signatures = fixed.SIGNATURES
) -> DataFrame:
    """The same hits, summed per project and kept apart by kind."""
    scanner = scanner_for(signatures)
    pairs = [(fw, kind) for fw in signatures for kind in signatures[fw]]
    scanned = files.filter(is_listed(F.col("path"), config)).select("project_id", "content", *scanner.columns())
    sums = scanned.groupBy("project_id").agg(
        *[F.sum(scanner.count(signatures[fw][kind])).alias(f"s{i}") for i, (fw, kind) in enumerate(pairs)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(fw).alias("framework"), F.lit(kind).alias("kind"), F.col(f"s{i}").alias("hits"))
            for i, (fw, kind) in enumerate(pairs)
        ]
    )
    return sums.select("project_id", F.inline(rows))


def database_class(content: Column) -> Column:
    """First database layer whose markers occur; null if none does."""
    return (
        F.when(
            F.contains(content, F.lit(fixed.ELOQUENT_BASE)) & contains_any(content, fixed.ELOQUENT_MARKERS),
            F.lit("eloquent"),
        )
        .when(contains_any(content, fixed.DOCTRINE_MARKERS), F.lit("doctrine"))
        .when(contains_any(content, fixed.ACTIVE_RECORD_CALLS), F.lit("active_record"))
        .when(contains_any(content, fixed.RAW_QUERY_MARKERS), F.lit("raw"))
    )


def _rooted(path: Column) -> Column:
    return F.concat(F.lit("/"), F.lower(path))


def is_service(content: Column, path: Column) -> Column:
    return F.contains(_rooted(path), F.lit("/service")) | (
        F.contains(content, F.lit("Injectable"))
        & (
            F.contains(content, F.lit("Phalcon\\Di\\Injectable"))
            | F.rlike(content, F.lit(word("extends") + r"\s+Injectable" + WORD_END))
        )
    )


def is_repository(content: Column, path: Column) -> Column:
    return F.contains(_rooted(path), F.lit("/repositor"))


def has_interface(content: Column, path: Column) -> Column:
    return F.rlike(content, F.lit("(?i)" + word("interface") + r"\s+\w+"))


def has_injection(content: Column, path: Column) -> Column:
    by_type = F.contains(content, F.lit("__construct")) & F.rlike(content, F.lit(fixed.CONSTRUCTOR))
    return by_type | contains_any(content, ("->getDI()", "getDI()->get("))


def is_orm_entity(content: Column, path: Column) -> Column:
    mapped = contains_any(content, fixed.DOCTRINE_MARKERS) | F.contains(content, F.lit("Phalcon\\Mvc\\Model"))
    return mapped | (
        F.contains(_rooted(path), F.lit("/model"))
        & F.rlike(content, F.lit(word("extends") + r"\s+\w*Model" + WORD_END))
    )


def is_test(content: Column, path: Column) -> Column:
    rooted = _rooted(path)
    return F.contains(rooted, F.lit("/test")) | F.endswith(rooted, F.lit("test.php"))


def is_coupled_test(content: Column, path: Column) -> Column:
    coupled = contains_any(content, fixed.COUPLED_TEST_MARKERS) | (
        F.contains(content, F.lit("extends TestCase")) & F.contains(content, F.lit("CreatesApplication"))
    )
    return is_test(content, path) & coupled


ARCHITECTURE_FLAGS: dict[str, Feature] = {
    "is_service": is_service,
    "is_repository": is_repository,
    "has_interface": has_interface,
    "has_injection": has_injection,
    "is_orm_entity": is_orm_entity,
}
TEST_FLAGS: dict[str, Feature] = {"is_test": is_test, "is_coupled_test": is_coupled_test}


def spaghetti_signals(content: Column) -> Column:
    """Signs of logic in a template, 0 to 20 and more; an integer, so sums stay exact."""

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, F.lit(n)).otherwise(F.lit(0))

    lines = line_count(content)
    return (
        F.least(F.lit(5), occurrences(content, "?>"))
        + points(contains_any(content, ("$_GET", "$_POST")), 3)
        + points(F.contains(content, F.lit("$_SESSION")), 2)
        + points(F.rlike(content, F.lit(word("new") + r"\s+[A-Z]")), 2)
        + points(contains_any(content, ("require", "include ")), 1)
        + points(contains_any(content, fixed.TEMPLATE_DB_MARKERS), 5)
        + points(lines > 200, 2)
        + points(lines > 500, 3)
    )


def capped_signals(content: Column) -> Column:
    return F.least(F.lit(20), spaghetti_signals(content))


def listed_flags(files: DataFrame, config: ScanConfig, flags: Mapping[str, Feature]) -> DataFrame:
    """Chosen features of the listed files."""
    content, path = F.col("content"), F.col("path")
    return files.filter(is_listed(path, config)).select(
        "project_id", "path", *[feature(content, path).alias(name) for name, feature in flags.items()]
    )


def database_file_class(files: DataFrame, config: ScanConfig) -> DataFrame:
    return listed_flags(
        files, config, {"db_class": lambda content, path: F.coalesce(database_class(content), F.lit("none"))}
    )


def template_spaghetti(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Score of every template listing entry, 0 to 1."""
    by_ending, by_directory = in_template_list(F.col("path"), config)
    lists = F.array_compact(F.array(F.when(by_ending, F.lit(0)), F.when(by_directory, F.lit(1))))
    return (
        files.filter(by_ending | by_directory)
        .select("project_id", "path", lists.alias("lists"), (capped_signals(F.col("content")) / 20).alias("spaghetti"))
        .select("project_id", "path", F.explode("lists").alias("list_no"), "spaghetti")
    )


def on_listings(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Files on any listing, and how often each lists them; decided by their paths alone."""
    path = F.col("path")
    by_ending, by_directory = in_template_list(path, config)
    return (
        files.withColumn("is_new", is_listed(path, config))
        .withColumn("legacy_n", legacy_times(path, config))
        .withColumn("template_n", by_ending.cast("int") + by_directory.cast("int"))
        .filter(F.col("is_new") | (F.col("legacy_n") > 0) | (F.col("template_n") > 0))
    )


def file_features(
    files: DataFrame,
    config: ScanConfig,
    signatures: Signatures = fixed.SIGNATURES,
    extra: Mapping[str, Feature] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Everything the reports need from a file, in one scan. Files on no listing are dropped.

    keys: columns of files that stay beside project_id.
    """
    content, path = F.col("content"), F.col("path")
    scanner = scanner_for(signatures)
    listings = on_listings(files, config)
    is_new, is_template = F.col("is_new"), F.col("template_n") > 0
    flags = {**ARCHITECTURE_FLAGS, **TEST_FLAGS, **(extra or {})}
    scanned = listings.select(
        "project_id",
        *keys,
        "is_new",
        "legacy_n",
        "template_n",
        F.when(is_new, database_class(content)).alias("db_class"),
        *[F.when(is_new, feature(content, path)).alias(name) for name, feature in flags.items()],
        F.when(is_template, capped_signals(content)).alias("signals"),
        "content",
        *scanner.columns(only_if="(is_new or legacy_n > 0)"),
    )
    kept = [c for c in scanned.columns if c not in ("content", *scanner.names)]
    return scanned.select(
        *kept,
        *[scanner.count(pack_literals(signatures, fw)).alias(f"hits_{fw}") for fw in signatures],
    )


def tally_numbers(signatures: Signatures = fixed.SIGNATURES) -> dict[str, str]:
    """SQL for what one file adds to each tally of its project."""
    numbers = {
        "file_count": "if(is_new, 1, 0)",
        "legacy_count": "legacy_n",
        "template_count": "template_n",
        "signals": "coalesce(signals, 0) * template_n",
        **{f"db_{name}": f"if(db_class = '{name}', 1, 0)" for name in DB_CLASSES},
        **{f"n_{name}": f"if({name}, 1, 0)" for name in (*ARCHITECTURE_FLAGS, *TEST_FLAGS)},
    }
    for fw in signatures:
        for name, at_least in (("coupled", 1), ("heavy", fixed.HEAVY_HITS)):
            numbers[f"{name}_{fw}"] = f"if(is_new and hits_{fw} >= {at_least}, 1, 0)"
            numbers[f"legacy_{name}_{fw}"] = f"if(hits_{fw} >= {at_least}, legacy_n, 0)"
    return numbers


def project_tallies(
    features: DataFrame,
    signatures: Signatures = fixed.SIGNATURES,
    extra: Mapping[str, Callable[[], Column]] | None = None,
) -> DataFrame:
    """One row of counts per project.

    Partial aggregation shrinks a project of any size before the only shuffle. All buffers are
    fixed-width, so both halves are hash aggregates.
    """
    return features.groupBy("project_id").agg(
        *[F.expr(f"sum({number})").alias(name) for name, number in tally_numbers(signatures).items()],
        *[build().alias(name) for name, build in (extra or {}).items()],
    )


def complete_tallies(projects: DataFrame, tallies: DataFrame) -> DataFrame:
    """Projects without files get zero counts; their scores have defined values."""
    return projects.select("project_id").join(tallies, "project_id", "left").fillna(0)


def template_engine_by_ending(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Engine of the first template with a telling ending. Reads paths only."""
    path = F.col("path")
    engine = F.lit(None).cast("string")
    for ending, name in reversed(list(fixed.TEMPLATE_ENGINES.items())):
        engine = F.when(F.endswith(path, F.lit(ending)), F.lit(name)).otherwise(engine)
    by_ending, _ = in_template_list(path, config)
    telling = ends_with_any(path, fixed.TEMPLATE_ENGINES)
    return files.filter(by_ending & telling).groupBy("project_id").agg(F.min_by(engine, path).alias("file_engine"))

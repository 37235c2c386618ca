"""The fixed values as small DataFrames.

Every dimension is built from a Python constant or list, so its row count is known when it is built. That
is the size check behind each ``broadcast`` of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.functions.text import sql_literal

MAX_BROADCAST_ROWS = 100_000


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A local relation of known size, marked for broadcast up to MAX_BROADCAST_ROWS rows."""
    fields = [field.split() for field in schema.split(",")]
    values = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    names = ", ".join(name for name, _ in fields)
    table = spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")
    return F.broadcast(table) if len(rows) <= MAX_BROADCAST_ROWS else table


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [
        (fw, n, package, i == 0, weight, i)
        for n, fw in enumerate(fixed.FRAMEWORKS)
        for i, (package, weight) in enumerate(fixed.CATALOGUE[fw])
    ]
    return small(
        spark, rows, "framework string, fw_ord int, name string, is_primary boolean, weight int, sub_ord int"
    )


def fingerprints(spark: SparkSession) -> DataFrame:
    """Known paths; ``path_bit`` numbers the paths of a framework by powers of two."""
    rows = [
        (fw, n, path, 1 << i) for n, fw in enumerate(fixed.FRAMEWORKS) for i, path in enumerate(fixed.FINGERPRINTS[fw])
    ]
    return small(spark, rows, "framework string, fw_ord int, fingerprint string, path_bit int")


def fingerprint_depth() -> int:
    return max(path.count("/") + 1 for paths in fixed.FINGERPRINTS.values() for path in paths)


def target_versions(spark: SparkSession) -> DataFrame:
    rows = [
        (fw, runtime, version)
        for fw, versions in fixed.TARGET_VERSIONS.items()
        for runtime, version in zip(fixed.RUNTIME_VERSIONS, versions, strict=True)
    ]
    return small(spark, rows, "framework string, target_php string, target_version string")


def minimum_runtime(spark: SparkSession) -> DataFrame:
    rows = [(fw, major, minor) for fw, (major, minor) in fixed.MINIMUM_RUNTIME.items()]
    return small(spark, rows, "target_framework string, min_major int, min_minor int")


def options(spark: SparkSession, pairs: list[tuple[str | None, str | None]]) -> DataFrame:
    """(source framework or null for the detected one, target framework) pairs to score."""
    return small(spark, pairs, "chosen_source string, target_framework string")


def runtimes(spark: SparkSession, versions: tuple[str, ...] = fixed.TARGET_RUNTIMES) -> DataFrame:
    return small(spark, [(v,) for v in versions], "target_php string")

"""Reports over checkouts, kept up to date without reading unchanged files again.

What each file adds to the tallies is stored under its path, size and time of change. A refresh lists the
checkouts, reads the files whose stamp is new, and commits the numbers of these together with those that still hold. Both
reports are made of the tallies, which are sums over the narrow stored rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.operators import features
from shiftgauge.operators.files import ScanConfig
from shiftgauge.sources.checkouts import list_checkouts, read_committed, read_contents, write_committed

STAMP = ["project_id", "path", "bytes", "modified"]


def _schema(signatures: features.Signatures) -> StructType:
    texts = [StructField(name, StringType()) for name in STAMP[:2]]
    return StructType([*texts, *[StructField(name, LongType()) for name in (*STAMP[2:], *features.tally_numbers(signatures))]])


def stored_numbers(spark: SparkSession, store: str, signatures: features.Signatures = fixed.SIGNATURES) -> DataFrame:
    """The rows that the last refresh committed: stamp and numbers of every file on a listing."""
    return read_committed(spark, store, _schema(signatures))


def changed_files(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed files that are not known under the same stamp."""
    same = [listed[c].eqNullSafe(known[c]) for c in STAMP]
    return listed.join(known.select(*STAMP), same, "left_anti")


def refresh(spark: SparkSession, root: str, store: str, config: ScanConfig, signatures: features.Signatures = fixed.SIGNATURES) -> DataFrame:
    """Tallies of all projects that have files on a listing, after storing what has changed.

    A store belongs to one root, configuration and pack of signatures. Files that are gone lose their rows. A file that is
    written while it is read counts as changed next time, as its stamp is taken before. A refresh that fails leaves
    the store as it was.
    """
    listed = features.on_listings(list_checkouts(spark, root, config), config).select(*STAMP)
    known = stored_numbers(spark, store, signatures)
    changed = changed_files(listed, known)
    same = [known[c].eqNullSafe(listed[c]) for c in STAMP]
    kept = known.join(listed, same, "left_semi")
    stamps = changed.withColumns({"size_then": F.col("bytes"), "modified_then": F.col("modified")})
    found = features.file_features(read_contents(stamps, root), config, signatures, keys=("path", "size_then", "modified_then"))
    numbers = [F.expr(sql).cast("long").alias(name) for name, sql in features.tally_numbers(signatures).items()]
    fresh = found.select(
        "project_id", "path", F.col("size_then").alias("bytes"), F.col("modified_then").alias("modified"), *numbers
    )
    write_committed(kept.unionByName(fresh), store)
    return refreshed_tallies(spark, store, signatures)


def refreshed_tallies(spark: SparkSession, store: str, signatures: features.Signatures = fixed.SIGNATURES) -> DataFrame:
    """The tallies as of the last refresh."""
    sums = [F.sum(name).alias(name) for name in features.tally_numbers(signatures)]
    return stored_numbers(spark, store, signatures).groupBy("project_id").agg(*sums)

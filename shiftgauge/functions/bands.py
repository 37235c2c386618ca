"""Score labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftgauge.functions import fixed_values as fixed


def band(score: Column, bands: list[tuple[int | None, str]]) -> Column:
    """Label of the first band whose exclusive upper bound is above the score; null for a null score."""
    *bounded, (_, last) = bands
    out = F.when(score.isNotNull(), F.lit(last))
    for bound, label in reversed(bounded):
        out = F.when(score < bound, F.lit(label)).otherwise(out)
    return out


def migration_band(score: Column) -> Column:
    return band(score, fixed.MIGRATION_BANDS)


def upgrade_band(score: Column) -> Column:
    return band(score, fixed.UPGRADE_BANDS)


def legacy_label(score: Column) -> Column:
    return band(score, fixed.LEGACY_LABELS)

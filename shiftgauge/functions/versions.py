"""Version expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftgauge.functions import fixed_values as fixed
from shiftgauge.functions.text import contains_any, sql_literal

# Order of the words in a version; a number ranks 4, as does the end of the version.
# The end sorts below every number, so 1.0-RC1 < 1.0 < 1.0.1 < 1.0-patch1 holds.
WORD_RANKS = [("dev", 0), ("a", 1), ("b", 2), ("RC", 3), ("rc", 3), ("#", 4), ("p", 5)]
NUMBER_RANK = 4
WORD_EDGE = r"(?<=\d)(?=[^\d.])|(?<=[^\d.])(?=\d)"


def _segment(version: Column, index: int) -> Column:
    digits = F.regexp_replace(F.coalesce(version, F.lit("")), r"[^0-9.]", "")
    return F.coalesce(F.get(F.split(digits, r"\."), F.lit(index)).try_cast("bigint"), F.lit(0).cast("bigint"))


def major(version: Column) -> Column:
    """First number once everything but digits and dots is dropped; 0 if there is none."""
    return _segment(version, 0)


def minor(version: Column) -> Column:
    return _segment(version, 1)


def is_unstable(version: Column) -> Column:
    return contains_any(F.coalesce(version, F.lit("")), fixed.UNSTABLE_MARKERS)


def version_key(version: str) -> Column:
    """``array<bigint>`` that orders versions as PHP orders them: a (rank, number) pair per part.

    ``version`` names a column. Plain dotted numbers, by far the most common form, skip the regular
    expressions that set words apart from numbers.
    """
    dotted = (
        f"if({version} rlike '[^0-9.]', regexp_replace(translate({version}, '-_+', '...'), "
        f"{sql_literal(WORD_EDGE)}, '.'), {version})"
    )
    ranks = " ".join(f"when startswith(part, '{word}') then {rank}L" for word, rank in WORD_RANKS)
    number = f"array({NUMBER_RANK}L, coalesce(try_cast(part as bigint), {2**63 - 1}L))"
    # A part that starts with a digit consists of digits only.
    pairs = (
        f"transform(filter(split({dotted}, '[.]'), part -> part != ''), "
        f"part -> if(part >= '0' and part < ':', {number}, array(case {ranks} else -1L end, 0L)))"
    )
    return F.expr(f"if({version} is null, null, concat(flatten({pairs}), array({NUMBER_RANK}L, -1L)))")

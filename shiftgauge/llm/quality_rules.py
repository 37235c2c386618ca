"""Quality rules with thresholds that adapt to language and source.

Each measure of a document falls into a bucket: numbers up to 64 exactly, larger ones by their highest
six bits, so a bucket is at most 1/32 of its numbers wide. The count of each bucket for each language and
source is a quantile sketch of bounded size; sketches merge by adding counts. To its own counts a group adds
those of its language, and a language those of all documents, scaled to a fixed number of documents: the
larger a group is, the more its own count, and no size is a switch. Fences come from the quartiles, and the
filter is a join of documents with the fences of their group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftgauge.llm.common import stored

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Fence:
    """Documents beyond a quartile by `reach` times the spread fail; a spread counts as `least` at least."""

    measure: str
    least: int
    reach: float = 3.0
    upper: bool = True
    lower: bool = False


FENCES = (
    Fence("symbol_rate", least=30),
    Fence("dup_line_rate", least=100),
    Fence("repeat_rate", least=100),
    Fence("word_length", least=100, lower=True),
)
#: So many documents a language's sketch counts as in those of its groups, and that of all documents in a language's.
LEAST_GROUP = 200
#: Lines added to every text's, so that one repeated line of a few weighs little.
SHORT_TEXT_LINES = 5
#: Buckets up to this number are exact.
EXACT = 64

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(names: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more; names: a number below len(names) for each word."""
    n = len(names)
    if n < 4:
        return 0
    windows = names[:-2].astype(np.int64) * n + names[1:-1]
    windows = np.unique(windows, return_inverse=True)[1].astype(np.int64) * n + names[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The counts of one text, in the order of COUNTS."""
    if not text:
        return (0,) * 6
    words = text.encode().split()  # bytes are split at ASCII white space, as the rules want
    lines = [line for line in text.split("\n") if line.encode().split()]
    numbers: dict[bytes, int] = {}
    names = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    return (
        len(words),
        len(text) - sum(map(text.count, "\t\n\x0b\x0c\r ")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(names) if len(numbers) < len(words) else 0,
        len(lines),
    )


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and the four measures of every document."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in COUNTS.split(", ")]
        for batch in batches:
            counts = pd.DataFrame(map(text_counts, batch["text"]), columns=names, index=batch.index)
            yield pd.concat([batch.drop(columns="text"), counts], axis=1)

    kinds = {"doc_id": "long", "lang": "string", "source": "string", "text": "string"}
    rows = docs.select(*[docs[c].cast(kind).alias(c) for c, kind in kinds.items()])
    counted = rows.mapInPandas(count, f"doc_id long, lang string, source string, {COUNTS}")
    rate = lambda part, whole, unit: F.floor(F.lit(unit) * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumns({
        "base_failed": failed,
        "symbol_rate": rate("n_symbols", "word_chars", 1000),
        "dup_line_rate": F.floor(1000 * F.col("n_dup_lines") / (F.col("n_lines") + SHORT_TEXT_LINES)),
        "repeat_rate": rate("n_repeat_words", "n_words", 1000),
        "word_length": rate("word_chars", "n_words", 100),
    })


def bucket(value: Column) -> Column:
    """The lowest number of the value's bucket; numbers are whole and not negative."""
    width = F.pow(F.lit(2), F.greatest(F.length(F.bin(value)) - 6, F.lit(0))).cast("long")
    return F.when(value < EXACT, value).otherwise(value - value % width)


def sketches(measured: DataFrame, fences: tuple[Fence, ...] = FENCES) -> DataFrame:
    """lang, source, measure, bucket, n. Documents that fail the base rules do not count."""
    pairs = F.array(*[F.struct(F.lit(f.measure).alias("measure"), bucket(F.col(f.measure)).alias("bucket")) for f in fences])
    return (
        measured.filter(~F.col("base_failed"))
        .select("lang", "source", F.inline(pairs))
        .groupBy("lang", "source", "measure", "bucket")
        .agg(F.count("*").alias("n"))
    )


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, measure, size, q1, q3: the bucket that holds the number of rank ceil(n / 4), ceil(3 n / 4)."""
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketch.withColumns({"upto": upto, "size": F.sum("n").over(group)})
    # Sums of shares depend on the order of rows: rounding hides that.
    left = lambda quarter: F.round(4 * F.col("upto") - quarter * F.col("size"), 6)
    at = lambda quarter: F.min(F.when(left(quarter) >= 0, F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(F.max("size").alias("size"), at(1).alias("q1"), at(3).alias("q3"))


def blended(sketch: DataFrame, keys: tuple[str, ...], prior: DataFrame, prior_keys: tuple[str, ...], weight: int) -> DataFrame:
    """Sketches of groups by keys, with the prior of each one's prior_keys added as `weight` documents."""
    groups = sketch.select(*keys, "measure").distinct()
    whole = F.sum("n").over(Window.partitionBy(*prior_keys, "measure"))
    shares = prior.withColumn("n", F.round(weight * F.col("n") / whole, 9)).withColumnsRenamed(
        {k: f"prior_{k}" for k in (*prior_keys, "measure")}
    )
    same = F.col("measure") == F.col("prior_measure")
    for k in prior_keys:
        same &= F.col(k).eqNullSafe(F.col(f"prior_{k}"))
    columns = [*keys, "measure", "bucket", F.col("n").cast("double").alias("n")]
    return merged(sketch.select(*columns).unionByName(groups.join(shares, same).select(*columns)), *keys)


def thresholds(sketch: DataFrame, fences: tuple[Fence, ...] = FENCES, least_group: int = LEAST_GROUP) -> DataFrame:
    """One row per language and source: MEASURE_low and MEASURE_high, null where nothing bounds."""
    by_lang = blended(merged(sketch, "lang"), ("lang",), merged(sketch), (), least_group)
    own = blended(sketch, ("lang", "source"), by_lang, ("lang",), least_group)
    taken = quartiles(own, "lang", "source").withColumn("taken", F.struct("q1", "q3"))
    columns = []
    for f in fences:
        of = F.when(F.col("measure") == f.measure, F.col("taken"))
        spread = F.greatest(of["q3"] - of["q1"], F.lit(f.least))
        if f.upper:
            columns.append(F.max(of["q3"] + f.reach * spread).alias(f"{f.measure}_high"))
        if f.lower:
            columns.append(F.max(of["q1"] - f.reach * spread).alias(f"{f.measure}_low"))
    return taken.groupBy("lang", "source").agg(*columns)


def quality_rules(docs: DataFrame, fences: tuple[Fence, ...] = FENCES, least_group: int = LEAST_GROUP) -> DataFrame:
    """The measures, fences and verdict of every document (doc_id, text, lang, source).

    `kept` is false for documents that fail the base rules or lie beyond a fence of their language and
    source. Null and empty texts have no words and fail. Null languages and sources are groups of their
    own. Rows that repeat are judged one by one, extra columns are left out, empty tables give no rows.
    """
    measured = stored(measures(docs), "measures")
    fenced = thresholds(sketches(measured, fences), fences, least_group)
    bounds = fenced.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    beyond = F.lit(False)
    for f in fences:
        if f.upper:
            beyond |= F.coalesce(F.col(f.measure) > F.col(f"{f.measure}_high"), F.lit(False))
        if f.lower:
            beyond |= F.coalesce(F.col(f.measure) < F.col(f"{f.measure}_low"), F.lit(False))
    return (
        measured.join(bounds, same, "left")
        .withColumn("kept", ~F.col("base_failed") & ~beyond)
        .drop("of_lang", "of_source", "n_lines")
    )

"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade >= k) is the logistic of (text score - threshold k): one weight per hashed feature, shared by all
grades, and ordered thresholds. Features are runs of three and five UTF-8 bytes, by their share in the text, and
the text's shape (how many words differ, how long it is), hashed into the same weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgauge.llm.common import BLOCK_CHARACTERS, blocks
from shiftgauge.llm.labelled import labelled_sample

BUCKETS = 1 << 13
RUNS = (3, 5)
#: Factor of the shares of byte runs, so that they weigh about as much as the shape.
SHARE = 30.0
#: The fit sees at most so many rows of each grade, and no text longer than that.
FIT_ROWS, FIT_CHARACTERS = 1200, 50_000
STEPS, RATE, PULL = 400, 0.05, 1e-4
#: Documents are kept whose chance of this grade or a higher one is at least this.
KEPT_GRADE, KEPT_FROM = 1, 0.5
#: Bytes between two places where a long text's byte runs are summed up.
PIECE_BYTES = 4_000_000

# Odd multipliers that mix bytes.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


def _hashed(data: np.ndarray, run: int) -> np.ndarray:
    """Buckets of all runs of bytes."""
    n = len(data) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    mixed = np.zeros(n, np.uint32)
    wide = data.astype(np.uint32)
    for place in range(run):
        mixed += wide[place : place + n] * np.uint32(MULTIPLIERS[place])
    mixed *= np.uint32(MULTIPLIERS[0])
    return mixed >> np.uint32(32 - (BUCKETS - 1).bit_length())


def shape(text: str) -> list[int]:
    """Buckets of a text's shape."""
    words = text.encode().split()
    total = max(1, len(words))
    distinct = len(set(words))
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    names = (
        f"distinct {10 * distinct // total}",
        f"stutter {min(9, 20 * stutter // total)}",
        f"words {len(words).bit_length()}",
        f"letters {min(30, len(text) // total)}",
    )
    return [zlib.crc32(name.encode()) % BUCKETS for name in names]


def weighted(text: str, weights: np.ndarray) -> float:
    """The text's score: shares of byte runs times their weights, plus the weights of its shape."""
    data = np.frombuffer(text.encode(), np.uint8)
    total, count = 0.0, 0
    for run in RUNS:
        for start in range(0, len(data), PIECE_BYTES):
            found = _hashed(data[start : start + PIECE_BYTES + run - 1], run)
            total += float(weights[found].sum(dtype=np.float64))
            count += len(found)
    return SHARE * total / max(1, count) + float(weights[shape(text)].sum())


def features(text: str) -> np.ndarray:
    """All features of a text, such that features @ weights is weighted(text, weights)."""
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.zeros(BUCKETS)
    for run in RUNS:
        counts += np.bincount(_hashed(data, run), minlength=BUCKETS)
    out = SHARE * counts / max(1.0, counts.sum())
    np.add.at(out, shape(text), 1)
    return out.astype(np.float32)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass(frozen=True)
class OrdinalModel:
    """grades in ascending order; a threshold for each but the lowest."""

    grades: tuple[int, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each grade but the lowest; rows: texts."""
        return _logistic(np.asarray(scores)[:, None] - self.thresholds[None, :])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        steps = np.diff(np.array(self.grades, float))
        return self.grades[0] + tails @ steps if len(steps) else np.full(len(tails), float(self.grades[0]))

    def score(self, texts: list[str | None]) -> np.ndarray:
        return np.array([weighted(t or "", self.weights) for t in texts])


def fit(texts: list[str], grades: list[int]) -> OrdinalModel:
    """Fit by Adam on the cumulative-link likelihood, grades balanced by weight.

    With one grade only, or none (then grade 0), every text is given that grade.
    """
    levels = tuple(sorted(set(grades))) or (0,)
    if len(levels) == 1:
        return OrdinalModel(levels, np.zeros(BUCKETS, np.float32), np.zeros(0))
    x = np.empty((len(texts), BUCKETS), np.float32)
    for row, text in zip(x, texts, strict=True):
        row[:] = features(text)
    y = np.searchsorted(levels, grades)
    n_cuts = len(levels) - 1
    reached = (y[:, None] > np.arange(n_cuts)).astype(np.float64)
    balance = len(y) / len(levels) / np.bincount(y)[y]
    weights = np.zeros(BUCKETS)
    raw = np.zeros(n_cuts)  # the first threshold, then logs of the gaps between thresholds
    moments = [np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(n_cuts), np.zeros(n_cuts)]
    for step in range(1, STEPS + 1):
        gaps = np.exp(raw[1:])
        cuts = raw[0] + np.concatenate([[0], np.cumsum(gaps)])
        eta = x @ weights.astype(np.float32)
        tails = _logistic(eta[:, None] - cuts)
        # Probability of the own grade: upper tail of its cut less that of the next one.
        upper = np.concatenate([np.ones((len(y), 1)), tails], axis=1)
        lower = np.concatenate([tails, np.zeros((len(y), 1))], axis=1)
        own = np.maximum((upper - lower)[np.arange(len(y)), y], 1e-9)
        slope = tails * (1 - tails)
        # d own / d cut k is -slope where k is the own grade's cut, +slope where it is the next one's.
        sign = (reached * (y[:, None] == np.arange(n_cuts) + 1)) - (y[:, None] == np.arange(n_cuts))
        g_cuts = (balance / own)[:, None] * sign * slope / len(y)
        g_eta = -g_cuts.sum(axis=1)
        g_weights = x.T @ g_eta.astype(np.float32) + PULL * weights
        per_cut = g_cuts.sum(axis=0)
        g_raw = np.concatenate([[per_cut.sum()], [per_cut[k:].sum() * gaps[k - 1] for k in range(1, n_cuts)]])
        for value, g, a, b in ((weights, g_weights, 0, 1), (raw, g_raw, 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * g
            moments[b] = 0.99 * moments[b] + 0.01 * g * g
            value -= RATE * (moments[a] / (1 - 0.9**step)) / (np.sqrt(moments[b] / (1 - 0.99**step)) + 1e-8)
    cuts = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
    return OrdinalModel(levels, weights.astype(np.float32), cuts)


def graded() -> Column:
    """Rating 0, 1 or 2 from the marks of labels: poor; good but toxic; good and clean. Null marks give none."""
    good = F.col("quality").isin(1)
    return F.when(F.col("quality").isin(0), 0).when(good & F.col("toxic").isin(1), 1).when(good, 2)


def train(docs: DataFrame, labels: DataFrame, rating: Column | None = None, fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fit on at most fit_rows rows of each rating that are not held out."""
    sample, _ = labelled_sample(docs, labels, graded() if rating is None else rating, fit_rows, FIT_CHARACTERS)
    return fit([text for text, _ in sample], [grade for _, grade in sample])


def grade_texts(model: OrdinalModel, text: Column) -> Column:
    """A struct of text score, expected grade and the tail probabilities, lowest cut first."""
    kind = "struct<text_score: double, expected_grade: double, tails: array<double>>"

    @F.pandas_udf(kind)
    def grade(texts: pd.Series) -> pd.DataFrame:
        values = list(texts)
        scores = [model.score(values[a:b]) for a, b in blocks([len(v or "") for v in values], BLOCK_CHARACTERS)]
        scores = np.round(np.concatenate(scores), 5) if scores else np.zeros(0)
        tails = model.tails(scores)
        columns = {"text_score": scores, "expected_grade": model.expected(tails), "tails": list(tails)}
        return pd.DataFrame(columns)

    return grade(text)


def kept(model: OrdinalModel, grade: int, least: float, graded: str = "graded") -> Column:
    """Whether the chance of `grade` or a higher one is at least `least`; graded: the column of grade_texts."""
    cut = next((i for i, g in enumerate(model.grades[1:]) if g >= grade), None)
    if cut is None:  # no such cut was learnt: nothing speaks against a text
        return F.lit(True)
    return F.coalesce(F.col(graded)["tails"][cut] >= least, F.lit(False))


def ordinal_quality(
    docs: DataFrame, labels: DataFrame, rating: Column | None = None, grade: int = KEPT_GRADE, least: float = KEPT_FROM
) -> DataFrame:
    """doc_id, text_score, expected_grade, tails, kept of every row of docs (doc_id, text).

    Null texts are graded as empty ones. Null doc_ids and repeated rows are graded like any other; extra
    columns are left out. Without labels every text has grade 0 and is kept.
    """
    model = train(docs, labels, rating)
    return graded_rows(model, docs).select(
        "doc_id", "graded.text_score", "graded.expected_grade", "graded.tails", kept(model, grade, least).alias("kept")
    )


def graded_rows(model: OrdinalModel, docs: DataFrame) -> DataFrame:
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), grade_texts(model, docs["text"].cast("string")).alias("graded")
    )

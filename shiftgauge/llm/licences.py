"""Licence statements, paragraph by paragraph; a paragraph is a run of lines without a blank one.

A sparse logistic regression on word n-grams, one class for each licence family and one for other text, is
fitted on templates and a bounded sample of paragraphs. Only n-grams of templates have weights, so the table
of weights is as small as the templates, and a paragraph without any of them is other text. A temperature
calibrates the probabilities; a prediction counts if the best template of its family shares enough n-grams
with the paragraph.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = (1, 2, 3)
UNKNOWN = "unknown"
#: Paragraphs of other text that the fit sees at most, characters of each, and documents that they come from.
FIT_PARAGRAPHS, FIT_CHARACTERS, FIT_DOCUMENTS = 2000, 2000, 500
#: A family is predicted from this probability on; templates must be covered to this share.
LEAST_PROBABILITY, LEAST_COVER = 0.5, 0.6
#: N-grams that a larger share of other paragraphs holds say nothing, and have no weight.
MOST_COMMON = 0.01
STEPS, RATE, SPARSE = 300, 0.3, 1e-4
#: A statement begins its last line within so many words, twice those of the longest template; in as many lines at most.
STATEMENT_WORDS = 42
#: What tells documents apart; the hash of the text also does so for null and repeated ids.
DOCUMENT = ("doc_id", "text_key")
#: Lines of a text that are cut into windows at a time.
CHUNK_LINES = 64

# Phrases by which licences are stated.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "this project is licensed under the terms of the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability",
        "spdx-license-identifier mit",
    ),
    "isc": (
        "released under the isc license",
        "licensed under the isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "spdx-license-identifier isc",
    ),
    "epl": (
        "licensed under the eclipse public license 2.0",
        "made available under the terms of the eclipse public license v. 2.0",
        "spdx-license-identifier epl-2.0",
    ),
    "apache": (
        "licensed under the apache license version 2.0",
        "released under the apache license 2.0",
        "you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
        "spdx-license-identifier apache-2.0",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "spdx-license-identifier gpl-3.0-or-later",
        "spdx-license-identifier gpl-2.0-only",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "spdx-license-identifier lgpl-2.1-or-later",
        "spdx-license-identifier lgpl-3.0-only",
    ),
    "agpl": (
        "licensed under the gnu affero general public license",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license",
        "spdx-license-identifier agpl-3.0-or-later",
    ),
    "bsd": (
        "licensed under the bsd 3-clause license",
        "released under the bsd 2-clause license",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "spdx-license-identifier bsd-3-clause",
        "spdx-license-identifier bsd-2-clause",
    ),
    "mpl": (
        "licensed under the mozilla public license version 2.0",
        "this source code form is subject to the terms of the mozilla public license v. 2.0",
        "spdx-license-identifier mpl-2.0",
    ),
    "cc-by-nc": (
        "licensed under cc by-nc 4.0",
        "licensed under cc by-nc-sa 4.0",
        "licensed under a creative commons attribution-noncommercial 4.0 international license",
    ),
    "cc-by": (
        "licensed under cc by 4.0",
        "licensed under cc by-sa 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
    ),
    "public-domain": (
        "released under cc0 1.0",
        "this work is dedicated to the public domain",
        "this is free and unencumbered software released into the public domain",
    ),
}
#: Before these words of a template, "not" denies it: such wordings are other text.
DENIED = ("licensed", "released")
WORD_CHARACTERS = "a-z0-9.+-"


def python_words(text: str) -> list[str]:
    """The words of a paragraph as licence_words finds them."""
    found = re.sub(rf"[^{WORD_CHARACTERS}]+", " ", text.lower())
    return [w for w in re.sub(r"[.-]+( |$)", r"\1", found).split(" ") if w]


def licence_words(text: Column) -> Column:
    """Words of letters, digits, dots and signs in lower case, without dots or hyphens at their ends."""
    runs = F.split(F.lower(text), f"[^{WORD_CHARACTERS}]+")
    return F.filter(F.transform(runs, lambda w: F.rtrim(w, F.lit(".-"))), lambda w: w != "")


def python_grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in ORDERS for i in range(len(words) - n + 1)}


def denied(words: list[str]) -> list[str]:
    """The statement with "not" before its verb; no words if it has none of DENIED."""
    at = next((i for i, w in enumerate(words) if w in DENIED), None)
    return [] if at is None else [*words[:at], "not", *words[at:]]


@dataclass(frozen=True)
class LicenceModel:
    """weights: a row for each n-gram of the templates, a column for each family; other text scores 0."""

    families: tuple[str, ...]
    grams: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(others: list[str], seed: int = 5) -> LicenceModel:
    """Fit on variants of the templates and on paragraphs of other text.

    Variants lose words, stand within other text, or follow it, so that wordings near the templates count;
    other text includes templates' words out of order and denied templates. A fifth of all is kept for the temperature.
    """
    draw = np.random.default_rng(seed)
    families = tuple(TEMPLATES)
    filler = [w for w in map(python_words, others) if w] or [["other", "text"]]
    common = Counter(g for w in filler for g in python_grams(w))
    templates = [python_words(t) for texts in TEMPLATES.values() for t in texts]
    stated = {g for words in templates for g in python_grams(words)}
    stated |= {g for words in templates for g in python_grams(denied(words)) if g.startswith("not ")}
    grams = tuple(sorted(g for g in stated if common[g] <= MOST_COMMON * len(filler)))
    number = {g: i for i, g in enumerate(grams)}
    examples: list[tuple[list[str], int]] = []
    for label, family in enumerate(families):
        for template in TEMPLATES[family]:
            words = python_words(template)
            for _ in range(20):
                kept = [w for w in words if draw.random() > 0.1] or words
                around = filler[draw.integers(len(filler))]
                cut = draw.integers(0, min(30, len(around)) + 1)
                examples.append(([kept, around[:cut] + kept, kept + around[:cut]][draw.integers(3)], label))
                mixed = [w for w in draw.permutation(words).tolist() if draw.random() > 0.5]
                examples.append((around[:cut] + mixed, len(families)))
                if denied(words):
                    examples.append((around[:cut] + denied(kept), len(families)))
    examples += [(w, len(families)) for w in filler]
    x = np.zeros((len(examples), len(grams)))
    for row, (words, _) in enumerate(examples):
        x[row, [number[g] for g in python_grams(words) if g in number]] = 1
    y = np.eye(len(families) + 1)[[label for _, label in examples]]
    fitted = np.arange(len(examples)) % 5 != 4
    weights, bias = np.zeros((len(grams), len(families))), np.zeros(len(families))
    widened = lambda s: np.concatenate([s, np.zeros((len(s), 1))], axis=1)
    sums = [np.zeros_like(weights), np.zeros_like(bias)]
    for _ in range(STEPS):
        error = (_softmax(widened(x[fitted] @ weights + bias)) - y[fitted])[:, :-1] / fitted.sum()
        g_weights, g_bias = x[fitted].T @ error, error.sum(axis=0)
        sums[0] += g_weights**2
        sums[1] += g_bias**2
        rates = RATE / (np.sqrt(sums[0]) + 1e-6)
        weights -= rates * g_weights
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rates * SPARSE, 0)  # pull to exact zeros
        bias -= RATE / (np.sqrt(sums[1]) + 1e-6) * g_bias
    held = x[~fitted] @ weights + bias
    loss = lambda t: -np.log((_softmax(widened(held / t)) * y[~fitted]).sum(axis=1) + 1e-12).mean()
    temperature = min((2.0 ** (k / 4) for k in range(-8, 13)), key=loss)
    return LicenceModel(families, grams, np.round(weights, 6), np.round(bias, 6), temperature)


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its number from 0), text: lines of every text that have more than white space."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))
    return lines.filter(F.col("text").rlike("[^ \\t\\r]"))


def other_paragraphs(docs: DataFrame, most: int = FIT_PARAGRAPHS) -> list[str]:
    """At most `most` paragraphs, without those that speak of licences, of FIT_DOCUMENTS documents.

    Documents are taken in the order of a hash of their id, paragraphs in that of a hash of their text.
    """
    ids = docs.select(docs["doc_id"].cast("long").alias("taken")).orderBy(F.xxhash64("taken"), "taken").limit(FIT_DOCUMENTS)
    # At most FIT_DOCUMENTS rows of one number.
    some = docs.join(F.broadcast(ids.distinct()), docs["doc_id"].cast("long").eqNullSafe(F.col("taken")), "left_semi")
    plain = paragraphs(some).filter(~F.lower("text").rlike("licen|copyright|permission|redistribut|public domain"))
    short = plain.select(F.substring("text", 1, FIT_CHARACTERS).alias("text")).distinct()
    return [r["text"] for r in short.orderBy(F.xxhash64("text"), "text").limit(most).collect()]


def weight_table(spark: SparkSession, model: LicenceModel) -> DataFrame:
    """gram and an array of weights, of the n-grams that have any: no longer than the n-grams of TEMPLATES."""
    rows = [(g, w.tolist()) for g, w in zip(model.grams, model.weights, strict=True) if np.any(w)]
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    return spark.createDataFrame(rows, schema)


def template_table(spark: SparkSession, model: LicenceModel) -> DataFrame:
    """The n-grams of each template that have weights, and how many these are."""
    weighted = {g for g, w in zip(model.grams, model.weights, strict=True) if np.any(w)}
    rows = [
        (family, place, gram, len(found))
        for family, texts in TEMPLATES.items()
        for place, text in enumerate(texts)
        for found in [python_grams(python_words(text)) & weighted]
        for gram in sorted(found)
    ]
    return spark.createDataFrame(rows, "family string, template int, gram string, template_grams int")


def word_grams(words: str, firsts: list[str]) -> Column:
    """The n-grams of a column of words that begin with one of `firsts`."""
    # The first word decides whether an n-gram can match, so most places end at a look-up of one word.
    numbered = F.transform(words, lambda word, at: F.when(word.isin(firsts), at + 1))
    return F.flatten(F.transform(F.array_compact(numbered), lambda at: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(max(ORDERS)), F.size(words) - at + 1)),
        lambda n: F.array_join(F.slice(words, at, n), " "),
    )))


def text_chunks(rows: DataFrame) -> DataFrame:
    """Keys of rows, at, lines: the words of the lines from `at` on, null for blank lines.

    Texts are cut into chunks of CHUNK_LINES lines, with those that statements in them reach, so that no row
    but the text's own holds all of it.
    """
    keys = [c for c in rows.columns if c != "text"]
    with_lines = lambda cut: F.transform(F.array(F.split("text", "\n")), cut)[0]  # noqa: E731 - splits once
    chunks = rows.select(*keys, F.explode(with_lines(lambda lines: F.transform(
        F.sequence(F.lit(0), F.size(lines) - 1, F.lit(CHUNK_LINES)),
        lambda at: F.struct(at.alias("at"), F.slice(lines, at + 1, CHUNK_LINES + STATEMENT_WORDS).alias("lines")),
    ))).alias("chunk"))
    worded = F.transform("chunk.lines", lambda x: F.when(x.rlike("[^ \\t\\r]"), licence_words(x)))
    return chunks.select(*keys, F.col("chunk.at").alias("at"), worded.alias("lines"))


def statement_windows(cut: DataFrame, firsts: list[str]) -> DataFrame:
    """Keys of chunks, paragraph, last, part, words: runs of lines of one paragraph, by the numbers of the first and the last.

    Runs begin at lines with a word of `firsts`; without the others before it, a run holds the same known n-grams.
    A run takes further lines while it has fewer than STATEMENT_WORDS words, and 2 * STATEMENT_WORDS words of each of
    these at most: a statement that reaches further into a line begins in it. Longer runs are cut into parts of
    twice STATEMENT_WORDS words that overlap by half.
    """
    keys = [c for c in cut.columns if c not in ("at", "lines")]
    begins = F.filter(
        F.sequence(F.lit(0), F.least(F.size("lines"), F.lit(CHUNK_LINES)) - 1),
        lambda i: F.exists(F.get("lines", i), lambda w: w.isin(firsts)),
    )
    nothing = F.array().cast("array<array<string>>")

    def run(i: Column) -> Column:
        """The lines from i on that a statement which begins there can reach."""
        begun = F.struct(nothing.alias("lines"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def take(so_far: Column, line: Column) -> Column:
            more = so_far["open"] & line.isNotNull() & (so_far["n"] < STATEMENT_WORDS)
            held = F.when(F.size(so_far["lines"]) == 0, line).otherwise(F.slice(line, 1, 2 * STATEMENT_WORDS))
            return F.when(more, F.struct(
                F.concat(so_far["lines"], F.array(held)).alias("lines"), (so_far["n"] + F.size(line)).alias("n"), F.lit(True).alias("open"),
            )).otherwise(F.struct(so_far["lines"].alias("lines"), so_far["n"].alias("n"), F.lit(False).alias("open")))

        return F.aggregate(F.slice("lines", i + 1, STATEMENT_WORDS), begun, take)["lines"]

    begun = cut.select(*keys, F.explode(F.transform(begins, lambda i: F.struct((F.col("at") + i).alias("paragraph"), run(i).alias("run")))).alias("b"))
    runs = begun.select(*keys, "b.paragraph", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("b.run")),
        lambda n: F.struct((F.col("b.paragraph") + n - 1).alias("last"), F.flatten(F.slice("b.run", 1, n)).alias("whole")),
    )).alias("r"))
    wide = runs.select(*keys, "paragraph", F.col("r.last").alias("last"), F.col("r.whole").alias("whole"))
    # Runs over several lines are as long as their first part: further parts lie within their last line.
    parts = F.when(F.col("last") > F.col("paragraph"), F.array(F.lit(1))).otherwise(
        F.sequence(F.lit(1), F.greatest(F.size("whole") - STATEMENT_WORDS, F.lit(1)), F.lit(STATEMENT_WORDS))
    )
    sliced = F.transform(parts, lambda at: F.slice("whole", at, 2 * STATEMENT_WORDS))
    return wide.select(*keys, "paragraph", "last", F.posexplode(sliced).alias("part", "words"))


def matched_grams(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """DOCUMENT, paragraph, last, part, gram, weights: the distinct n-grams of windows that have weights.

    Texts none of whose templates is covered even by all their n-grams have no rows.
    """
    spark = docs.sparkSession
    weighted = {g for g, w in zip(model.grams, model.weights, strict=True) if np.any(w)}
    firsts = sorted({g.split(" ")[0] for g in weighted})
    strings = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    stated = lambda words: F.array_distinct(F.filter(word_grams(words, firsts), lambda g: g.isin(sorted(weighted))))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    words = rows.select(*DOCUMENT, "text", F.explode(F.array(licence_words(F.col("text")))).alias("words"))
    templates = [python_grams(python_words(t)) & weighted for texts in TEMPLATES.values() for t in texts]

    def stating(held: DataFrame) -> DataFrame:
        """Rows whose words can cover a template."""
        covered = F.lit(False)
        for grams in filter(None, templates):
            covered |= F.size(F.array_intersect("known", strings(sorted(grams)))) >= LEAST_COVER * len(grams)
        known = held.withColumn("known", F.explode(F.array(stated("words"))))
        return known.filter((F.size("known") > 0) & covered).drop("known", "words")

    chunks = text_chunks(stating(words))
    # Most chunks of a long text state nothing.
    chunks = stating(chunks.withColumn("words", F.explode(F.array(F.flatten(F.array_compact("lines"))))))
    return (
        statement_windows(chunks, firsts)
        .select(*DOCUMENT, "paragraph", "last", "part", F.explode(stated("words")).alias("gram"))
        .distinct()
        .join(F.broadcast(weight_table(spark, model)), "gram")
    )


def smallest_windows(stated: DataFrame) -> DataFrame:
    """Of windows of one document and family that lie in or overlap one another, the smallest, or the first of these."""
    first = stated.groupBy(*DOCUMENT, "paragraph", "family").agg(
        F.min(F.struct("last", (-F.col("cover")).alias("least"), (-F.col("probability")).alias("chance"))).alias("w")
    )
    of = Window.partitionBy(*DOCUMENT, "family").orderBy("paragraph")
    # From the last row on, so that the frame only grows.
    after = Window.partitionBy(*DOCUMENT, "family").orderBy(F.desc("paragraph"))
    ends = first.select(
        *DOCUMENT, "paragraph", "family", F.col("w.last").alias("last"),
        (-F.col("w.chance")).alias("probability"), (-F.col("w.least")).alias("cover"),
    )
    inner = F.min("last").over(after.rowsBetween(Window.unboundedPreceding, -1))
    least = ends.withColumn("inner", inner).filter(F.col("inner").isNull() | (F.col("inner") > F.col("last")))
    before = F.lag("last").over(of)
    return least.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") < F.col("paragraph")))


def licences(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """doc_id, paragraph, family, probability, cover of every paragraph that states a licence.

    `family` is predicted with LEAST_PROBABILITY or more, and one of its templates has LEAST_COVER or more of its
    n-grams in the paragraph; `cover` is the best such share. Other paragraphs are of the unknown class and have no
    row. `paragraph` is the number, from 0, of the line in which the statement begins; a statement may go over several
    lines, up to a blank one. Null and empty texts have no paragraphs. Rows with the same doc_id, null or not, are
    different documents if their texts differ, and one if they are equal. Extra columns are left out; empty tables
    give no rows. Texts may be of any length that a row can hold, of few or many lines.
    """
    model = model or fit(other_paragraphs(docs))
    found = matched_grams(docs, model)
    keys = (*DOCUMENT, "paragraph", "last", "part")
    sums = [
        (F.sum(F.col("weights")[i]) + F.lit(float(model.bias[i]))).alias(f"score_{i}") for i in range(len(model.families))
    ]
    # Sums of doubles depend on the order of rows: rounding hides that.
    scored = found.groupBy(*keys).agg(*sums)
    exps = [F.exp(F.round(F.col(f"score_{i}"), 6) / model.temperature) for i in range(len(model.families))]
    total = sum(exps[1:], exps[0]) + F.lit(1.0)
    ranked = F.array(*[
        F.struct((e / total).alias("probability"), F.lit(name).alias("family"))
        for e, name in zip(exps, model.families, strict=True)
    ])
    predicted = scored.select(*keys, F.array_max(ranked).alias("best")).select(*keys, "best.family", "best.probability")
    predicted = predicted.filter(F.col("probability") >= LEAST_PROBABILITY)
    hits = found.select(*keys, "gram").join(F.broadcast(template_table(docs.sparkSession, model)), "gram")
    covers = hits.groupBy(*keys, "family", "template").agg((F.count("*") / F.max("template_grams")).alias("cover"))
    best = covers.groupBy(*keys, "family").agg(F.max("cover").alias("cover")).filter(F.col("cover") >= LEAST_COVER)
    of = best.select(*[F.col(k).alias(f"of_{k}") for k in (*keys, "family")], "cover")
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id"))
    for k in (*keys[1:], "family"):  # doc_id alone may be null
        same &= F.col(k) == F.col(f"of_{k}")
    return smallest_windows(predicted.join(of, same)).select(
        "doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family",
        F.round("probability", 4).alias("probability"), F.round("cover", 4).alias("cover"),
    )

"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str | Column) -> Column:
    """Rows that no fit may see: crc32 of the id as text, modulo 4, is 2. Null ids are not held out."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, grade: Column, most_per_grade: int, most_characters: int
) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Texts and grades, and the number of labelled rows of each grade; texts of at most `most_per_grade` rows of each grade that are not held out.

    grade: a whole number from the columns of labels; rows where it is null are left out. Rows are taken
    in the order of a hash of their id, one per document, with its greatest text if the id is repeated; texts over `most_characters` characters are not
    used for fitting. The sample is the same for the same tables, in an order that does not depend on
    partitions.
    """
    graded = labels.select(labels["doc_id"].cast("long").alias("doc_id"), grade.cast("int").alias("grade"))
    graded = graded.filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    graded = graded.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    sizes = dict(sorted(tuple(r) for r in graded.groupBy("grade").count().limit(100).collect()))
    order = (F.xxhash64("doc_id"), "doc_id")
    taken = None
    for g in sizes:
        some = graded.filter(F.col("grade") == g).orderBy(*order).limit(most_per_grade)
        taken = some if taken is None else taken.unionByName(some)
    if taken is None:
        return [], {}
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    texts = texts.filter(F.col("text").isNotNull() & (F.length("text") <= most_characters))
    joined = texts.join(F.broadcast(taken), "doc_id")  # at most grades x most_per_grade rows of two numbers
    once = joined.groupBy("doc_id", "grade").agg(F.max("text").alias("text"))  # repeats of an id end here, not on the driver
    return [(r["text"], r["grade"]) for r in sorted(once.collect(), key=lambda r: r["doc_id"])], sizes

"""Benchmark decontamination by MinHash containment search.

An item of n distinct shingles is contained in a document that holds at least `percent` of them, whatever
the document's length. Items are partitioned by size, in classes that double; the MinHash signature of an item
is its smallest shingle hashes, so many in each class that a document with enough of the item's shingles must
hold one of them. Every shingle of every document is looked up among these minima, documents too small for
the item are left out, and what is found is verified on exact shingles. No contained item is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgauge.llm.common import WORD_GAP, stored

WORDS, PERCENT = 5, 80
WHITE_SPACE = " \t\n\x0b\x0c\r"


def text_words(text: Column) -> Column:
    """Words in lower case; null and blank texts have none."""
    trimmed = F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WHITE_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def places(words: Column, n: int) -> Column:
    """Starts of the shingles; texts of fewer words have one, texts without words none."""
    last = F.greatest(F.size(words) - n, F.lit(0)) + 1
    return F.when(F.size(words) > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def with_words(rows: DataFrame, *kept: str) -> DataFrame:
    """The kept columns and `words`. The generator keeps Spark from splitting the text again for each use."""
    return rows.select(*kept, F.explode(F.array(text_words(F.col("text")))).alias("words"))


def hashes(n: int) -> Column:
    """A hash of each shingle of the column words, as an array."""
    return F.transform(places(F.col("words"), n), lambda at: F.xxhash64(F.slice("words", at, n)))


def shingles(n: int) -> Column:
    """Distinct shingles of the column words, as strings."""
    return F.array_distinct(F.transform(places(F.col("words"), n), lambda at: F.array_join(F.slice("words", at, n), " ")))


def needed(n: Column, percent: int) -> Column:
    """The fewest of n shingles that are `percent` of them."""
    return F.ceil(F.lit(percent) * n / 100).cast("int")


def signed_items(items: DataFrame, n: int, percent: int) -> DataFrame:
    """item_id, item_shingles, needed, size_class, minima of items (item_id, text) that have a word and an id.

    minima: the smallest hashes of the item's shingles. In the class of sizes 2^c ... 2^(c+1) - 1 there are as
    many as the largest size of the class may miss, and one more.
    """
    rows = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    cut = with_words(rows.filter("item_id is not null"), "item_id").withColumn("found", shingles(n)).filter("size(found) > 0")
    sized = cut.withColumn("item_shingles", F.size("found"))
    sized = sized.withColumn("size_class", F.length(F.bin("item_shingles")) - 1)
    largest = F.pow(F.lit(2), F.col("size_class") + 1).cast("int") - 1
    most = largest - needed(largest, percent) + 1
    return sized.select(
        "item_id",
        "item_shingles",
        needed(F.col("item_shingles"), percent).alias("needed"),
        "size_class",
        F.slice(F.array_sort(F.array_distinct(hashes(n))), F.lit(1), most).alias("minima"),
        "found",
    )


def candidates(docs: DataFrame, signed: DataFrame, n: int) -> DataFrame:
    """doc_id, item_id: documents that hold a minimum of an item and are not too small for it."""
    minima = stored(signed.select("item_id", "needed", F.explode("minima").alias("hash")), "minima")
    size = F.greatest(F.size("words") - n, F.lit(0)) + 1
    hashed = with_words(docs, "doc_id").select("doc_id", size.alias("size"), F.explode(hashes(n)).alias("hash"))
    found = hashed.join(minima, "hash").filter(F.col("size") >= F.col("needed"))
    return found.select("doc_id", "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, item_shingles, shared: every item of which a document holds `percent` or more.

    Texts are in lower case, words split at ASCII white space; a text of fewer than n words is one shingle.
    Items without words and rows without an id match nothing; repeated rows of a document or an item count
    once, with the text that shares most. Extra columns are left out; empty tables give no rows.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.filter("doc_id is not null")
    signed = stored(signed_items(items, n, percent), "items")
    pairs = stored(candidates(rows, signed, n), "pairs")
    named = pairs.join(signed.select("item_id", "item_shingles", "needed", "found"), "item_id")
    texts = rows.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    cut = with_words(texts, "doc_id").select("doc_id", shingles(n).alias("held"))
    shared = F.size(F.array_intersect("held", "found"))
    verified = cut.join(named, "doc_id").withColumn("shared", shared).filter(F.col("shared") >= F.col("needed"))
    return verified.groupBy("doc_id", "item_id").agg(
        F.max_by("item_shingles", F.struct("shared", "item_shingles")).cast("long").alias("item_shingles"),
        F.max("shared").cast("long").alias("shared"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Documents, all columns, without those that contain an item. Rows without doc_id stay."""
    found = stored(contained(docs, items, n, percent).select("doc_id").distinct(), "contaminated")
    return docs.join(found, docs["doc_id"] == found["doc_id"], "left_anti")

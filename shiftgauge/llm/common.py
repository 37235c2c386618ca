"""Shared folders, stored steps and word rules of the text operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

# A word is a run of characters that are no ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Characters that a task works on at a time, one text at least.
BLOCK_CHARACTERS = 2_000_000
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Whether shuffle files are removed when the query that wrote them has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folder of sessions without spark.checkpoint.dir.
_OWN: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, as a full URI; where that is unset, as in tests, below one of our own.

    On a cluster it must be set, as executors elsewhere do not see a folder of the driver.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="shared-"))
        root = _OWN[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: cuts the lineage, and survives lost executors.

    Shuffle files of the write go with its end, not whenever the driver collects its garbage.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(folder)


#: Bitmaps of 4 KB that go to every task at most, 64 MB; beyond them rows and keys meet by a shuffle.
MOST_BITMAPS = 16_384


def rows_with(rows: DataFrame, key: str, keys: DataFrame, among: bool = True) -> DataFrame:
    """The rows whose whole number `key` is among those of `keys`, a table of one column; those where it is not, if not `among`.

    Rows do not move: the keys become bitmaps of 32,768 following numbers each, which are broadcast. So the numbers should lie close
    together, as those of the rows of a stored table do.
    """
    number = keys.columns[0]
    place, bits = F.bitmap_bit_position(number), F.bitmap_bucket_number(number)
    marks = keys.select(bits.alias("marked_range"), place.alias("marked_place")).groupBy("marked_range")
    marks = stored(marks.agg(F.bitmap_construct_agg("marked_place").alias("marks")), "bitmaps")
    how = "left_semi" if among else "left_anti"
    if marks.count() > MOST_BITMAPS:
        return rows.join(keys, rows[key] == keys[number], how)
    at = F.bitmap_bit_position(rows[key])
    byte = F.conv(F.hex(F.substring(marks["marks"], F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
    return rows.join(F.broadcast(marks), (F.bitmap_bucket_number(rows[key]) == marks["marked_range"]) & marked, how)


def new_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as it takes to be none of the columns; case does not tell names apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: str | Column) -> Column:
    """Words of a text as an array; null has none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(column, F.lit("")), WORD_GAP), lambda word: word != "")


def ascii_lower(text: str | Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: What the operator that used this worker last keeps in memory from task to task.
_HELD: dict[str, tuple[object, object]] = {}


def held(owner: object, make: Callable[[], T]) -> T:
    """What `make` gave for this owner, as long as no other owner has asked in between.

    Workers are used again by the next operator, which must not pay for the tables of the last one.
    """
    if "it" not in _HELD or _HELD["it"][0] != owner:
        _HELD.clear()
        gc.collect()
        _HELD["it"] = (owner, make())
    return _HELD["it"][1]  # type: ignore[return-value]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths add up to `most` or less, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)

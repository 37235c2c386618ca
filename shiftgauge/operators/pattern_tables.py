"""Signatures and package prefixes as tables of any length, instead of expressions.

A pack of literals becomes an index of short pieces, one for each literal: the piece that fewest others of the pack
have. All positions of a text are looked up in it at once, and what is found is compared byte by byte. So a
text is passed once for each block of the pack, however many literals that has, and the plan stays the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftgauge.functions.workers import importable
from shiftgauge.operators.files import ScanConfig, is_listed

#: Bytes of literals that one pass over the files looks for, one literal at least.
PACK_BYTES = 4_000_000
#: Bytes of texts that a task looks up at a time, one text at least.
TEXT_BYTES = 8_000_000
#: Longest piece, which fits a 32-bit number.
PIECE = 4
#: Pairs of a place and a literal that are compared at a time.
COMPARED = 200_000


@dataclass
class Pieces:
    """Pieces of one length in order, and for each the literals that have it, with its place in them."""

    length: int
    values: np.ndarray
    ends: np.ndarray
    literals: np.ndarray
    offsets: np.ndarray
    seen: np.ndarray


def _numbers(data: np.ndarray, length: int) -> np.ndarray:
    """The piece that starts at each place, as a number."""
    n = max(0, len(data) - length + 1)
    found = np.zeros(n, np.uint32)
    for i in range(length):
        found |= data[i : i + n].astype(np.uint32) << np.uint32(8 * i)
    return found


def _slot(pieces: np.ndarray) -> np.ndarray:
    return (pieces * np.uint32(2654435761)) >> np.uint32(16)


def overlaps_itself(literal: bytes) -> bool:
    return any(literal.startswith(literal[i:]) for i in range(1, len(literal)))


class PackIndex:
    """Literals, and the pieces by which they are found."""

    def __init__(self, literals: list[bytes]):
        self.literals = literals
        self.lengths = np.array([len(x) for x in literals], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(literals), np.uint8)
        self.overlapping = np.array([overlaps_itself(x) for x in literals], bool)
        shared = Counter(p for x in literals for p in {x[i : i + PIECE] for i in range(len(x) - PIECE + 1)})
        chosen: dict[int, list[tuple[int, int, int]]] = {}
        for number, literal in enumerate(literals):
            length = min(len(literal), PIECE)
            at = min(range(len(literal) - length + 1), key=lambda i: shared[literal[i : i + PIECE]])
            chosen.setdefault(length, []).append((int.from_bytes(literal[at : at + length], "little"), number, at))
        self.pieces = [self._pieces(length, sorted(found)) for length, found in sorted(chosen.items())]

    @staticmethod
    def _pieces(length: int, found: list[tuple[int, int, int]]) -> Pieces:
        every, numbers, offsets = (np.array(c) for c in zip(*found, strict=True))
        values, first = np.unique(every.astype(np.uint32), return_index=True)
        seen = np.zeros(1 << 16, bool)
        seen[_slot(values)] = True
        return Pieces(length, values, np.append(first, len(found)), numbers, offsets, seen)

    def _same(self, data: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Whether the literals stand at these places."""
        same = np.ones(len(starts), bool)
        for step in range(0, len(starts), COMPARED):
            some = np.arange(step, min(step + COMPARED, len(starts)))
            lengths, i = self.lengths[numbers[some]], 0
            # Byte by byte over the pairs that are still equal and not at their end.
            while len(some):
                equal = data[starts[some] + i] == self.bytes[self.starts[numbers[some]] + i]
                same[some[~equal]] = False
                i += 1
                going = equal & (lengths > i)
                some, lengths = some[going], lengths[going]
        return same

    def found(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, literal and place of all occurrences, in this order; texts stand in data one after the other."""
        texts, numbers, places = [], [], []
        for p in self.pieces:
            values = _numbers(data, p.length)
            at = np.flatnonzero(p.seen[_slot(values)])
            where = np.minimum(np.searchsorted(p.values, values[at]), len(p.values) - 1)
            known = p.values[where] == values[at]
            at, where = at[known], where[known]
            many = p.ends[where + 1] - p.ends[where]
            pick = np.repeat(p.ends[where] - np.cumsum(many) + many, many) + np.arange(many.sum())
            number = p.literals[pick]
            start = np.repeat(at, many) - p.offsets[pick]
            text = np.searchsorted(ends, np.maximum(start, 0), "right")
            begins = np.where(text > 0, ends[np.maximum(text - 1, 0)], 0)
            inside = (start >= begins) & (start + self.lengths[number] <= ends[np.minimum(text, len(ends) - 1)])
            start, number, text = start[inside], number[inside], text[inside]
            same = self._same(data, start, number)
            texts.append(text[same])
            numbers.append(number[same])
            places.append(start[same])
        text, number, place = (np.concatenate(x) for x in (texts, numbers, places))
        order = np.lexsort((place, number, text))
        return text[order], number[order], place[order]

    def counts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, literal and number of occurrences that do not overlap, from the left."""
        text, number, place = self.found(data, ends)
        if not len(text):
            return text, number, place
        first = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (np.diff(number) != 0)])
        n = np.diff(np.append(first, len(text)))
        for i in np.flatnonzero(self.overlapping[number[first]] & (n > 1)).tolist():
            free, taken = -1, 0
            for x in place[first[i] : first[i] + n[i]].tolist():
                if x >= free:
                    free, taken = x + int(self.lengths[number[first[i]]]), taken + 1
            n[i] = taken
        return text[first], number[first], n


def _blocks(pack: DataFrame) -> Iterator[dict[bytes, list[str]]]:
    """Literals and their owners, in blocks that fit the driver and the tasks."""
    block: dict[bytes, list[str]] = {}
    size = 0
    rows = pack.select("framework", "literal").filter("literal <> '' and framework is not null").distinct()
    for row in rows.orderBy("literal", "framework").toLocalIterator():
        literal = row["literal"].encode()
        if literal not in block and block and size + len(literal) > PACK_BYTES:
            yield block
            block, size = {}, 0
        size += len(literal) + len(row["framework"])
        block.setdefault(literal, []).append(row["framework"])
    if block:
        yield block


def _counted(files: DataFrame, block: dict[bytes, list[str]]) -> DataFrame:
    index = PackIndex(list(block))
    owners = sorted({o for names in block.values() for o in names})
    number = {o: i for i, o in enumerate(owners)}
    owned = np.array([number[o] for names in block.values() for o in names], np.int64)
    owner_ends = np.cumsum([0, *(len(names) for names in block.values())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).cast(pa.large_binary()).fill_null(b"")
            lengths = np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1])
            start = 0
            while start < len(lengths):
                total = np.cumsum(lengths[start:])
                stop = start + max(1, int(np.searchsorted(total, TEXT_BYTES, "right")))
                data = np.frombuffer(b"".join(x.as_py() for x in sizes[start:stop]), np.uint8)
                text, literal, n = index.counts(data, total[: stop - start])
                many = owner_ends[literal + 1] - owner_ends[literal]
                pick = np.repeat(owner_ends[literal] - np.cumsum(many) + many, many) + np.arange(many.sum())
                key = np.repeat(text, many) * len(owners) + owned[pick]
                keys, back = np.unique(key, return_inverse=True)
                hits = np.bincount(back, np.repeat(n, many), len(keys)).astype(np.int64)
                rows = pa.array(keys // len(owners) + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows),
                     pa.array(owners, pa.string()).take(pa.array(keys % len(owners))), pa.array(hits)],
                    ["project_id", "path", "framework", "hits"],
                )
                start = stop

    importable(files.sparkSession)
    rows = files.select("project_id", "path", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(look, "project_id string, path string, framework string, hits long")


def pack_counts(files: DataFrame, pack: DataFrame, config: ScanConfig) -> DataFrame:
    """Hits per listed file and framework, for a pack (framework, literal) of any number of literals.

    Counts as `signature_counts` does: case-sensitive, and without overlaps of a literal with itself; a literal that a
    framework lists twice counts once. Rows without hits are left out, as are null and empty literals. Packs beyond
    PACK_BYTES are looked up in blocks, with a pass over the files for each.
    """
    listed = files.filter(is_listed(F.col("path"), config))
    parts = [_counted(listed, block) for block in _blocks(pack)]
    if not parts:
        return files.sparkSession.createDataFrame([], "project_id string, path string, framework string, hits long")
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("project_id", "path", "framework").agg(F.sum("hits").alias("hits"))


def prefix_matches(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """name, prefix, owner, longest: all prefixes (prefix, owner) that a distinct name begins with.

    A name is cut at each length that a prefix has, and the pieces are joined by equality. The
    lengths are a short list, bounded by the longest name. `longest` marks the most specific match, for all its owners. An empty
    prefix matches every name; null names and prefixes match nothing.
    """
    wanted = names.select("name").filter("name is not null").distinct()
    given = prefixes.select("prefix", "owner").filter("prefix is not null").distinct()
    longest = wanted.agg(F.max(F.length("name"))).first()[0] or 0
    size = F.length("prefix")
    lengths = sorted(r[0] for r in given.filter(size <= longest).select(size).distinct().collect())
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("name"))
    pieces = wanted.select("name", F.explode(F.transform(fitting, lambda n: F.substr("name", F.lit(1), n))).alias("prefix"))
    found = pieces.join(given, "prefix")
    most = F.max(size).over(Window.partitionBy("name"))
    return found.select("name", "prefix", "owner", (size == most).alias("longest"))

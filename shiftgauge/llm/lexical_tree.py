"""Ranked lexical search over document FP-trees.

A document is reduced to the terms that some item asks for, ordered from the most frequent in the corpus to
the rarest. Documents with equal beginnings of that sequence share a path, so in lexicographic order every
node of the trie is a run of documents. For each run the tree keeps the largest tf of every term and
the smallest length figure m below it; since a score grows with tf and falls with m, these bound all scores of the run. Each item
goes depth-first through the tree, best bound first, and leaves out what cannot enter its list.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftgauge.llm.common import stored

#: Characters of items, and items, that are looked for in one pass over the documents; one item at least.
ITEM_CHARACTERS, ITEMS = 4_000_000, 2_000
#: Terms of documents that one tree holds, one document at least.
TREE_TERMS = 2_000_000
#: Documents of neighbouring small branches that are scored together.
BUCKET = 64

# Terms are runs of ASCII letters and digits and of all that is not ASCII; A-Z count as a-z.
_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes((i + 32 if 0x41 <= i <= 0x5A else i) if i in _KEPT else 32 for i in range(256))
_SHARE, _TF, _M = 1_000_000_000, 1000, 8


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, in its order and with repeats."""
    return text.translate(_TABLE).split()


def length_figure(n: int, n_docs: int, n_terms: int) -> int:
    return 25 + (75 * n * n_docs) // n_terms


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one unit of weight adds to a score; grows with tf and falls with m."""
    return (_SHARE * tf) // (_TF * tf + _M * m)


def restricted_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs of documents with at least one term: all terms counted, those of the vocabulary kept."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, kept, tfs, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = terms(text.as_buffer().to_pybytes()) if text.is_valid else []
                if not found:
                    continue
                own = [(vocabulary[t], c) for t, c in Counter(found).items() if t in vocabulary]
                ids.append(doc_id.as_py())
                counts.append(len(found))
                kept += [t for t, _ in own]
                tfs += [c for _, c in own]
                ends.append(len(kept))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (kept, tfs)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"]
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(reduce, "doc_id long, n long, terms array<int>, tfs array<int>")


@dataclass
class Branches:
    """The branches of a node: runs of documents from `low` to `high`, with bounds on the shares of terms below them."""

    low: list[int]
    high: list[int]
    least_id: list[int]
    below: list[Branches | None]
    terms: np.ndarray
    shares: np.ndarray
    starts: np.ndarray


class Tree:
    """FP-tree of documents: ids, length figures, and for each its terms (by frequency rank) and their counts."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, ends: np.ndarray, ranks: np.ndarray, tfs: np.ndarray):
        lengths = np.diff(ends)
        row = np.repeat(np.arange(len(ids)), lengths)
        by_rank = np.lexsort((ranks, row))
        packed = ranks[by_rank].astype(">u4").tobytes()
        keys = [packed[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        order = np.array(sorted(range(len(ids)), key=keys.__getitem__), dtype=np.int64)
        self.ids, self.m = ids[order], m[order]
        self.starts = np.concatenate([[0], np.cumsum(lengths[order])])
        at = by_rank[np.arange(self.starts[-1]) + np.repeat(ends[:-1][order] - self.starts[:-1], lengths[order])]
        self.terms, self.tfs = ranks[at], tfs[at].astype(np.int64)
        self.shares = share(self.tfs, np.repeat(self.m, lengths[order]))
        self.most = np.zeros(int(ranks.max(initial=0)) + 1, np.int64)
        self.root = self._branches(0, len(ids), 0)[0]

    def _shared(self, low: int, high: int, depth: int) -> int:
        """Length of the path that all documents of a run share; the first and last of a sorted run tell it."""
        a = self.terms[self.starts[low] + depth : self.starts[low + 1]]
        b = self.terms[self.starts[high - 1] + depth : self.starts[high]]
        most = min(len(a), len(b))
        differ = np.flatnonzero(a[:most] != b[:most])
        return depth + int(differ[0] if len(differ) else most)

    def _maxima(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a subtree and the largest count of each."""
        every = np.concatenate([t for t, _ in parts])
        np.maximum.at(self.most, every, np.concatenate([c for _, c in parts]))
        found = np.unique(every)
        most = self.most[found]
        self.most[found] = 0
        return found, most

    def _branches(self, low: int, high: int, depth: int) -> tuple[Branches, list[tuple[np.ndarray, np.ndarray]]]:
        depth = self._shared(low, high, depth)
        at = self.starts[low:high] + depth
        ended = at == self.starts[low + 1 : high + 1]
        step = np.where(ended, -1, self.terms[np.minimum(at, len(self.terms) - 1)])
        cuts = [low, *(low + 1 + np.flatnonzero(np.diff(step))).tolist(), high]
        runs: list[list[int]] = []  # low, high, whether it has branches of its own
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = b - a > BUCKET and not ended[a - low]
            if runs and not own and not runs[-1][2] and b - runs[-1][0] <= BUCKET:
                runs[-1][1] = b
            else:
                runs.append([a, b, own])
        below, maxima = [], []
        for a, b, own in runs:
            branches, parts = self._branches(a, b, depth + 1) if own else (None, None)
            span = slice(self.starts[a], self.starts[b])
            below.append(branches)
            maxima.append(self._maxima(parts or [(self.terms[span], self.tfs[span])]))
        sizes = [len(t) for t, _ in maxima]
        least_m = np.repeat([self.m[a:b].min() for a, b, _ in runs], sizes)
        made = Branches(
            [a for a, _, _ in runs], [b for _, b, _ in runs], [int(self.ids[a:b].min()) for a, b, _ in runs], below,
            np.concatenate([t for t, _ in maxima]), share(np.concatenate([c for _, c in maxima]), least_m),
            np.concatenate([[0], np.cumsum(sizes)[:-1]]),
        )
        return made, maxima

    def search(self, weights: np.ndarray, best: np.ndarray, k: int) -> np.ndarray:
        """Rows of (score, id), best first: the k best of `best` and of this tree; equal scores by id."""
        todo: list[tuple[int, int, int, int, Branches | None]] = []
        floor = (int(best[-1, 0]), int(best[-1, 1])) if len(best) == k else (1, np.iinfo(np.int64).max)

        def push(branches: Branches) -> None:
            bounds = np.add.reduceat(weights[branches.terms] * branches.shares, branches.starts)
            for i in np.argsort(bounds).tolist():
                if bounds[i] >= floor[0]:
                    todo.append((int(bounds[i]), branches.least_id[i], branches.low[i], branches.high[i], branches.below[i]))

        push(self.root)
        while todo:
            bound, least_id, low, high, below = todo.pop()
            if bound < floor[0] or (bound == floor[0] and least_id > floor[1]):
                continue
            if below is not None:
                push(below)
                continue
            span = slice(self.starts[low], self.starts[high])
            scores = np.add.reduceat(weights[self.terms[span]] * self.shares[span], self.starts[low:high] - self.starts[low])
            good = np.flatnonzero(scores >= floor[0])
            if len(good):
                best = np.concatenate([best, np.stack([scores[good], self.ids[low + good]], axis=1)])
                best = best[np.lexsort((best[:, 1], -best[:, 0]))][:k]
                floor = (int(best[-1, 0]), int(best[-1, 1])) if len(best) == k else floor
        return best


#: Stands for a null doc_id, which comes after all others.
_NO_ID = np.iinfo(np.int64).max


def _trees(batches: Iterator[pa.RecordBatch], rank: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Tree]:
    """Trees over the vectors of a task, of TREE_TERMS terms each; documents without a term of the items are in none."""
    ids, m, ranks, tfs, lengths, held = [], [], [], [], [], 0

    def made() -> Tree:
        ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        return Tree(np.concatenate(ids), np.concatenate(m), ends, np.concatenate(ranks), np.concatenate(tfs))

    for batch in batches:
        size = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        doc = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        figure = np.array([length_figure(n, n_docs, n_terms) for n in batch.column(1).to_pylist()], np.int64)
        flat, counts = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
        ends = np.concatenate([[0], np.cumsum(size)])
        start = 0
        while start < len(size):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + TREE_TERMS - held, "right")) - 1)
            some, span = np.flatnonzero(size[start:stop]) + start, slice(ends[start], ends[stop])
            if len(some):
                ids.append(doc[some])
                m.append(figure[some])
                lengths.append(size[some])
                ranks.append(rank[flat[span]])
                tfs.append(counts[span])
                held += int(ends[stop] - ends[start])
            start = stop
            if held and start < len(size):
                yield made()
                ids, m, ranks, tfs, lengths, held = [], [], [], [], [], 0
    if held:
        yield made()


def _searched(vectors: DataFrame, rank: np.ndarray, wanted: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best documents of each task for each item."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty((0, 2), np.int64) for _ in wanted]
        for tree in _trees(batches, rank, n_docs, n_terms):
            weights = np.zeros(len(rank), np.int64)
            for i, (at, w) in enumerate(wanted):
                weights[at] = w
                best[i] = tree.search(weights, best[i], k)
                weights[at] = 0
        for i, rows in enumerate(best):
            if len(rows):
                ids = pa.array(rows[:, 1], pa.int64(), mask=rows[:, 1] == _NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(rows), pa.int32()), ids, pa.array(rows[:, 0], pa.int64())], ["item", "doc_id", "score"]
                )

    return vectors.select("doc_id", "n", "terms", "tfs").mapInArrow(search, "item int, doc_id long, score long")


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in order, in blocks that fit the driver and the tasks."""
    block, size = [], 0
    for row in items.orderBy(F.col("item_id").asc_nulls_first(), "text").toLocalIterator():
        if block and (len(block) == ITEMS or size + len(row["text"]) > ITEM_CHARACTERS):
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"].encode()))
        size += len(row["text"])
    if block:
        yield block


def _ranked_block(docs: DataFrame, block: list[tuple[int | None, bytes]], k: int) -> DataFrame:
    spark = docs.sparkSession
    asked = [Counter(terms(text)) for _, text in block]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*asked)))}
    vectors = stored(restricted_vectors(docs, vocabulary), "lexical-vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row per term of the block at most.
    df = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    rank = np.zeros(len(vocabulary), np.int64)
    for place, term in enumerate(sorted(df, key=lambda t: (-df[t], t))):
        rank[term] = place
    wanted = []
    for counts in asked:
        known = [(vocabulary[t], c) for t, c in counts.items() if vocabulary[t] in df]
        pairs = [(rank[i], c * weight(df[i], n_docs)) for i, c in known]
        wanted.append((np.array([r for r, _ in pairs], np.int64), np.array([w for _, w in pairs], np.int64)))
    found = _searched(vectors, rank, wanted, n_docs, n_terms, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return stored(best.join(F.broadcast(names), "item"), "lexical-ranks").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) for every item (item_id, text).

    Null and empty texts and texts without a term neither count nor match; an item without a known term has no row.
    Equal scores go by doc_id, null last; repeated documents are documents of their own. Equal rows of items are one
    item; an item_id with several texts, and a null one, has a list for each text. Empty tables give no rows. Texts of any length
    are read whole. Extra columns are left out. Items are taken in blocks, with a pass over the documents for each.
    """
    asked = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    result = None
    for block in _item_blocks(asked.filter("text is not null").distinct()):
        part = _ranked_block(docs, block, k)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return result

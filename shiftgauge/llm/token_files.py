"""Token files: concatenated ids, and document bounds in Elias-Fano form.

A shard is two files. `NAME.ids` holds the ids of its documents one after the other, as unsigned
little-endian integers of 16 bits where the vocabulary fits and 32 otherwise. `NAME.idx` holds the
document ids and the ends of documents, each as an Elias-Fano sequence: the low bits packed, the high
bits in unary, and the bit position of every 256th one as a 32-bit sample, from which `select` walks
on. There is no table of 64-bit offsets.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftgauge.llm.common import blocks, held, partitions, shared_folder, stored

MAGIC = b"EFTOK001"
#: Ones between two samples of the select structure.
SAMPLE = 256
#: Parts of texts that a worker remembers; beyond it the memory is cleared, results stay the same.
REMEMBERED = 500_000
REMEMBERED_CHARACTERS = 64
#: Bytes of texts that the writer encodes at a time, one text at least.
BLOCK_BYTES = 8_000_000
#: Ids that the reader holds at a time, one document at least.
READ_IDS = 2_000_000


class EliasFano:
    """A non-decreasing sequence of numbers below 2**63, in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[places] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        lows = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel() if low_bits else np.zeros(0, np.uint8)
        pack = lambda x: np.packbits(x, bitorder="little").tobytes()
        return cls(n, low_bits, pack(lows), pack(bits), places[::SAMPLE].astype("<u4"))

    def tobytes(self) -> bytes:
        samples = self.samples.tobytes()
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(samples))
        return head + self.low + self.high + samples

    @classmethod
    def parse(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, low, high, samples = struct.unpack_from("<QBQQQ", data, at)
        at += struct.calcsize("<QBQQQ")
        parts = []
        for size in (low, high, samples):
            parts.append(data[at : at + size])
            at += size
        return cls(n, low_bits, parts[0], parts[1], np.frombuffer(parts[2], "<u4")), at

    def values(self, start: int, stop: int) -> np.ndarray:
        """The numbers at start, ..., stop - 1."""
        if start >= stop:
            return np.zeros(0, np.int64)
        first, last = start // SAMPLE, (stop - 1) // SAMPLE + 1
        begin = int(self.samples[first])
        end = int(self.samples[last]) if last < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8)[begin // 8 : end // 8 + 1], bitorder="little")
        ones = np.flatnonzero(bits) + begin // 8 * 8
        ones = ones[ones >= begin][start - first * SAMPLE : stop - first * SAMPLE]
        high = ones - np.arange(start, stop)
        if not self.low_bits:
            return high
        begin, end = start * self.low_bits, stop * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8)[begin // 8 : end // 8 + 1], bitorder="little")
        bits = bits[begin % 8 : begin % 8 + end - begin].reshape(-1, self.low_bits).astype(np.int64)
        return (high << self.low_bits) + (bits << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        return int(self.values(i, i + 1)[0])


#: Letters, and marks that may follow them, of a piece that is cut in two. Marks are neither apostrophes nor what special
#: tokens are made of, so that the vocabulary's rules cut such a piece between both, and nowhere else.
SIMPLE = (
    "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]*)"
    r"(?P<marks>[.,!?;:#$%&*()\-=]*)$"
)
#: Parts that are handed to the library as one text.
JOINED = 1000


def _gathered(ids: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `ids` with these codes one after the other, and their ends; run i of `ids` ends at ends[i]."""
    lengths = np.diff(ends, prepend=0)[codes]
    stops = np.cumsum(lengths)
    places = np.repeat(ends[codes] - stops, lengths)
    places += np.arange(len(places))
    return ids[places], stops


class Encoder:
    """A tokenizers vocabulary that drops white space and cuts letters from marks, such as word_bpe_49k.json.

    Texts are cut at spaces and line feeds, and simple pieces into letters and marks, places that no token
    crosses. Each different part of a block is looked up once; what is new goes through the library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _whole(self, pieces: list[str]) -> dict[str, bytes]:
        encoded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return {p: np.array(e.ids, dtype=self.kind).tobytes() for p, e in zip(pieces, encoded, strict=True)}

    def _parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts that are one word of the vocabulary's rules each, encoded as texts of many words."""
        texts = [" ".join(parts[i : i + JOINED]) for i in range(0, len(parts), JOINED)]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in encoded), np.int64)
        lasts = np.flatnonzero(self.ends_word[ids])
        if len(lasts) != len(parts):  # a rule has cut a part further
            return self._whole(parts)
        data, cuts = ids.astype(self.kind).tobytes(), ((lasts + 1) * self.width).tolist()
        return {p: data[a:b] for p, a, b in zip(parts, [0, *cuts[:-1]], cuts, strict=True)}

    def _looked_up(self, simple: list[str], rest: list[str]) -> list[bytes]:
        """Ids of letters and marks, then those of other pieces."""
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        learned: dict[str, bytes] = {}
        for parts, encode in ((simple, self._parts), (rest, self._whole)):
            new = [p for p in parts if p not in self.known]
            if new:
                learned |= encode(new)
        self.known |= {p: i for p, i in learned.items() if len(p) <= REMEMBERED_CHARACTERS}
        return [learned[p] if p in learned else self.known[p] for p in chain(simple, rest)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, and their ends; null is empty."""
        pieces = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        # Different pieces as pairs of parts: letters and marks, or the piece and nothing.
        cut = pc.extract_regex(coded.dictionary, SIMPLE)
        simple = cut.is_valid()
        letters, marks = (pc.struct_field(cut.filter(simple), name) for name in ("letters", "marks"))
        both = pa.concat_arrays([pc.utf8_lower(letters), marks]).dictionary_encode()
        rest = coded.dictionary.filter(pc.invert(simple)).to_pylist()
        parts = both.dictionary.to_pylist()
        found = self._looked_up(parts, rest)
        pairs = np.empty((len(coded.dictionary), 2), np.int64)
        is_simple = simple.to_numpy(zero_copy_only=False)
        pairs[is_simple] = both.indices.to_numpy().reshape(2, -1).T
        pairs[~is_simple, 0] = len(parts) + np.arange(len(rest))
        pairs[~is_simple, 1] = len(found)
        found.append(b"")
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // self.width
        ids, stops = _gathered(np.frombuffer(b"".join(found), self.kind), ends, pairs.ravel())
        ids, stops = _gathered(ids, stops[1::2], coded.indices.to_numpy())
        return ids, np.concatenate([[0], stops])[pieces.offsets.to_numpy()[1:]]


def _encoder(path: str) -> Encoder:
    return held(("token files", path), lambda: Encoder(path))


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def index_bytes(doc_ids: list[int | None], lengths: list[int], kind: str) -> bytes:
    """The index file of documents in ascending order, null ids first."""
    nulls = sum(d is None for d in doc_ids)
    known = [int(d) for d in doc_ids[nulls:]]
    base = known[0] if known else 0
    offsets = np.array([d - base for d in known], dtype=np.uint64)
    ends = np.cumsum(np.array(lengths, dtype=np.uint64), dtype=np.uint64)
    head = MAGIC + kind.encode() + struct.pack("<Qq", nulls, base)
    return head + EliasFano.encode(offsets).tobytes() + EliasFano.encode(ends).tobytes()


class ShardIndex:
    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token index")
        self.kind = data[8:11].decode()
        self.nulls, self.base = struct.unpack_from("<Qq", data, 11)
        self.ids, at = EliasFano.parse(data, 11 + struct.calcsize("<Qq"))
        self.ends, _ = EliasFano.parse(data, at)
        self.n = self.ends.n

    def offset(self, i: int) -> int:
        """Ids in the shard before document i."""
        return self.ends.select(i - 1) if i else 0

    def doc_ids(self, start: int, stop: int) -> list[int | None]:
        some = max(start, self.nulls)
        return [None] * (min(stop, self.nulls) - min(start, self.nulls)) + [
            int(x) + self.base for x in self.ids.values(some - self.nulls, max(some, stop) - self.nulls)
        ]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Write shards of all documents in ascending doc_id order; return their list.

    The list has shard, n_docs and n_ids, in the order of the documents. Null texts are empty: their only
    id is the end id. Null doc_ids come first; rows with equal doc_id follow each other by a
    hash of their text. Empty
    tables give no shard. Extra columns are left out. A repeated task writes the same files again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer)
        name = f"{TaskContext.get().partitionId():08d}"
        files, root = _filesystem(folder)
        attempt = f"{root}/_attempts/{name}-{uuid.uuid4().hex}"
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        out = None
        for batch in batches:
            if out is None:
                files.create_dir(f"{root}/_attempts", recursive=True)
                out = files.open_output_stream(f"{attempt}.ids")
            texts = batch.column("text")
            for start, stop in blocks(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BLOCK_BYTES):
                ids, ends = encoder.encode(texts.slice(start, stop - start))
                out.write(np.insert(ids, ends, end_id).tobytes())
                lengths += (np.diff(ends, prepend=0) + 1).tolist()
            doc_ids += batch.column("doc_id").to_pylist()
        if out is None:
            return
        out.close()
        with files.open_output_stream(f"{attempt}.idx") as index:
            index.write(index_bytes(doc_ids, lengths, encoder.kind))
        for kind in ("ids", "idx"):
            files.move(f"{attempt}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [len(doc_ids)], "n_ids": [sum(lengths)]})

    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # Bounds of ranges are sampled to the driver, so texts stand in them by their hash.
    keys = (F.col("doc_id").asc_nulls_first(), "tie")
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(spark), *keys)
    ordered = dealt.sortWithinPartitions(*keys, "text").drop("tie")
    return stored(ordered.mapInArrow(write, "shard string, n_docs long, n_ids long"), "shards")


def read_token_files(shards: DataFrame, folder: str) -> DataFrame:
    """Read shards back: doc_id, start, n_tokens, ids.

    start counts the ids of all documents before; ids are little-endian unsigned 32-bit integers. The
    first ids of shards are sums over the list of shards, one row for each.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _filesystem(folder)
        for batch in batches:
            for shard, first in zip(batch["shard"], batch["first_id"], strict=True):
                with files.open_input_stream(f"{root}/{shard}.idx") as index:
                    bounds = ShardIndex(index.read())
                width = np.dtype(bounds.kind).itemsize
                with files.open_input_stream(f"{root}/{shard}.ids") as ids:
                    for start, stop in read_blocks(bounds):
                        offsets = np.concatenate([[bounds.offset(start)], bounds.ends.values(start, stop)])
                        data = np.frombuffer(ids.read(int(offsets[-1] - offsets[0]) * width), bounds.kind).astype("<u4")
                        cuts = offsets - offsets[0]
                        yield pd.DataFrame({
                            "doc_id": pd.array(bounds.doc_ids(start, stop), dtype="Int64"),
                            "start": offsets[:-1] + first,
                            "n_tokens": np.diff(offsets),
                            "ids": [data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                        })

    before = F.coalesce(
        F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    listed = shards.withColumn("first_id", before).select("shard", "first_id")
    spread = listed.repartition(partitions(shards.sparkSession))
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def read_blocks(bounds: ShardIndex) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about READ_IDS ids together."""
    start = 0
    while start < bounds.n:
        stop = min(start + 1024, bounds.n)
        while stop - start > 1 and bounds.offset(stop) - bounds.offset(start) > READ_IDS:
            stop = start + (stop - start) // 2
        yield start, stop
        start = stop


def token_files(docs: DataFrame, tokenizer: str, end_id: int, spark: SparkSession) -> DataFrame:
    """Encode, write and read back; the files stay in a folder of their own below spark.checkpoint.dir."""
    folder = shared_folder(spark, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, end_id, folder), folder)

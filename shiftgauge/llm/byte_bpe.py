"""Byte-level BPE through sentencepiece.

The model file is made straight from the ranks: each byte is one character of a 256 character block,
each token is the piece of its bytes' characters, and its score is its negative rank, so that the best
merge is the one of the lowest rank. The normaliser is the identity. Pre-tokens are encoded one by one,
since merges must not cross them; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import re
import struct
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgauge.llm.common import BLOCK_CHARACTERS, blocks, held

#: The character of byte b is chr(FIRST_CHARACTER + b).
FIRST_CHARACTER = 0x100
#: White space other than single spaces and line feeds; where there is some, each place is looked at.
PAIRS = ("  ", " \n", "\n ")
other_space = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
#: Distinct pieces of text and pre-tokens that a worker remembers; beyond it the memory is cleared, results stay the same.
REMEMBERED = 500_000
#: Longer pieces are not remembered.
REMEMBERED_CHARACTERS = 64

# Fields and types of the sentencepiece model format.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _TYPE = 1, 2, 3
_NORMAL, _UNKNOWN = 1, 2
_MODEL_TYPE, _BPE, _VOCAB_SIZE = 3, 2, 4
_UNK_ID, _BOS_ID, _EOS_ID, _PAD_ID = 40, 41, 42, 43
_NAME, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES = 1, 3, 4, 5


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of base64 tokens and ranks."""
    lines = Path(path).read_bytes().split(b"\n")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _characters(data: bytes) -> str:
    return "".join(chr(FIRST_CHARACTER + b) for b in data)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised BPE model whose piece ids are the ranks; one unknown piece follows them.

    Ranks must be 0, 1, 2, ... without gaps.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must count up from 0 without gaps")
    pieces = [
        _bytes(_PIECE, _characters(token).encode()) + struct.pack("<Bf", _SCORE << 3 | 5, -rank) + _number(_TYPE, _NORMAL)
        for rank, token in enumerate(tokens)
    ]
    pieces.append(_bytes(_PIECE, b"<unk>") + struct.pack("<Bf", _SCORE << 3 | 5, 0.0) + _number(_TYPE, _UNKNOWN))
    trainer = b"".join(
        _number(field, value)
        for field, value in (
            (_MODEL_TYPE, _BPE), (_VOCAB_SIZE, len(pieces)), (_UNK_ID, len(tokens)), (_BOS_ID, -1), (_EOS_ID, -1), (_PAD_ID, -1),
        )
    )
    normalizer = _bytes(_NAME, b"identity") + b"".join(_number(f, 0) for f in (_DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES))
    return b"".join(_bytes(_PIECES, p) for p in pieces) + _bytes(_TRAINER, trainer) + _bytes(_NORMALIZER, normalizer)


def cut(text: str) -> list[str]:
    """Pieces that start at a space between two characters that are no white space.

    No match of a pattern that takes white space only before or without other characters reaches across
    such a place, so the matches of the pieces are those of the text.
    """
    parts = text.split(" ")
    if parts[0] and parts[-1] and not any(map(text.__contains__, PAIRS)) and not other_space(text):
        return [parts[0], *[" " + p for p in parts[1:]]]
    pieces = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace() and pieces[-1] and not pieces[-1][-1].isspace():
            pieces.append(" " + part)
        else:
            pieces[-1] += " " + part
    return pieces


class ByteBpe:
    """Encoder and decoder of one vocabulary, made once per worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        import sentencepiece

        self.find = regex.compile(pattern).findall
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.token_bytes = pa.array(self.tokens, pa.large_binary())
        self.known: dict[str, bytes] = {}
        self.to_characters = {b: FIRST_CHARACTER + b for b in range(256)}

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces as packed int32, each of their pre-tokens encoded by itself.

        Letters, with a space before them or none, are one pre-token; other pieces are cut by the pattern.
        """
        found = {p: self.find(p) for p in pieces if not (p.isalpha() or p[:1] == " " and p[1:].isalpha())}
        tokens = [p for p in pieces if p not in found]
        tokens += set(chain.from_iterable(found.values())).difference(self.known, tokens)
        mapped = [t.encode().decode("latin-1").translate(self.to_characters) for t in tokens]
        ids = self.processor.encode(mapped, num_threads=1)
        packed = np.fromiter(chain.from_iterable(ids), "<i4").tobytes()
        ends = [0, *(4 * np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))).tolist()]
        learned = {t: packed[a:b] for t, a, b in zip(tokens, ends[:-1], ends[1:], strict=True)}
        known = self.known
        for piece, parts in found.items():
            learned[piece] = b"".join([learned[t] if t in learned else known[t] for t in parts])
        return learned

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed int32 ids of whole texts; null and empty texts have none."""
        found = [cut(text) if text else [] for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set(chain.from_iterable(found)).difference(self.known)
        learned = self._learn(list(new)) if new else {}
        short = {p: i for p, i in learned.items() if len(p) <= REMEMBERED_CHARACTERS}
        self.known |= short
        if len(short) < len(learned):
            return [b"".join([learned[p] if p in learned else self.known[p] for p in pieces]) for pieces in found]
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in found]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bytes of all ids, and the ends in them of the texts whose ids end at `ends`."""
        if not len(ids):
            return ends, b""
        # An id outside the vocabulary raises here.
        _, offsets, data = self.token_bytes.take(pa.array(ids)).buffers()
        return np.frombuffer(offsets, np.int64, len(ids) + 1)[ends], data.to_pybytes()


def _coder(path: str, pattern: str) -> ByteBpe:
    return held(("byte BPE", path, pattern), lambda: ByteBpe(read_ranks(path), pattern))


def _encoded(coder: ByteBpe, texts: pa.Array) -> pa.ListArray:
    """Ids of whole texts."""
    values = texts.to_pylist()
    packed: list[bytes] = []
    for start, stop in blocks([len(v or "") for v in values], BLOCK_CHARACTERS):
        packed += coder.encode(values[start:stop])
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))


def _decoded(coder: ByteBpe, lists: pa.ListArray) -> pa.Array:
    """Bytes of id arrays; null gives null."""
    ends = np.cumsum(np.concatenate([[0], lists.value_lengths().fill_null(0).to_numpy()]))
    cuts, data = coder.decode(lists.flatten().to_numpy(), ends)
    out = [data[a:b] if v else None for a, b, v in zip(cuts[:-1].tolist(), cuts[1:].tolist(), lists.is_valid().to_pylist(), strict=True)]
    return pa.array(out, pa.binary())


def encode_ids(text: str | Column, path: str, pattern: str) -> Column:
    """Ids of whole texts as array<int>, one rank per token; null and empty texts give an empty array."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _encoded(_coder(path, pattern), texts)

    return encode(text)


def decode_ids(ids: str | Column, path: str, pattern: str) -> Column:
    """Bytes of id arrays; null gives null. An id outside the vocabulary is an error."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        return _decoded(_coder(path, pattern), lists)

    return decode(ids)


def there_and_back(text: str | Column, path: str, pattern: str) -> Column:
    """A struct of the ids of whole texts, as of encode_ids, and of the bytes that decode_ids gives for them.

    Spark joins encode_ids and a decode_ids of its column to one step that encodes twice: for the ids, and again for their bytes.
    """

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def code(texts: pa.Array) -> pa.Array:
        coder = _coder(path, pattern)
        ids = _encoded(coder, texts)
        return pa.StructArray.from_arrays([ids, _decoded(coder, ids)], ["ids", "decoded"])

    return code(text)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Documents with their ids and the bytes that these give back: doc_id, ids, decoded.

    Null and empty texts have no ids and decode to no bytes. Repeated rows, null doc_ids and extra
    columns are no matter: each row is answered by itself, and other columns are left out.
    """
    coded = docs.select(docs["doc_id"], there_and_back(docs["text"].cast("string"), path, pattern).alias("coded"))
    return coded.select("doc_id", "coded.ids", "coded.decoded")

"""Byte-level BPE, token files and the archive against the libraries and exact round trips."""

import base64
import cProfile
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

import corpus_pipeline  # noqa: E402
from shiftgauge.llm import byte_bpe, queries, token_files, warc_archive  # noqa: E402
from shiftgauge.llm.common import shared_folder  # noqa: E402

ODD_TEXTS = [
    None, "", " ", "\n", "  a", "a  b \n c ", "x" * 50_000, "Don't they'll  we go　on", "\x1c a\x1fb", "12 3,4!?",
    "é ́x ẞ İstanbul ΣΣ", "<|endoftext|> a<|endoftext|>b", "\U0001f600\U0001f600 ok", "tab\tend\r\nnext", "a " * 3000,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "zz") for i, t in enumerate(ODD_TEXTS)] + [(3, "\n", "zz"), (None, "null id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_tiktoken_and_decodes(spark, odd):
    rows = byte_bpe.encode_decode(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(rows) == len(ODD_TEXTS) + 2
    known = _tiktoken()
    texts = dict(enumerate(ODD_TEXTS)) | {None: "null id"}
    for row in rows:
        text = texts[row["doc_id"]] or ""
        assert row["ids"] == known.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()


def test_byte_bpe_encodes_once_for_ids_and_bytes(spark, odd):
    path = P.path("byte_bpe_50k.tiktoken")
    docs = odd.select("doc_id", "text")
    for coded in (byte_bpe.encode_decode(odd, path, P.PATTERN), corpus_pipeline.tokens(spark, docs, "")):
        plan = coded._jdf.queryExecution().executedPlan().toString()
        assert "pythonUDF0" in plan and "pythonUDF1" not in plan
    apart = odd.select(byte_bpe.encode_ids("text", path, P.PATTERN).alias("ids")).select("ids", byte_bpe.decode_ids("ids", path, P.PATTERN))
    both = byte_bpe.encode_decode(odd, path, P.PATTERN).select("ids", "decoded")
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, apart.collect()), key=str)


def test_every_token_of_the_vocabulary_is_reached():
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    coder = byte_bpe.ByteBpe(ranks, P.PATTERN)
    mapped = ["".join(chr(byte_bpe.FIRST_CHARACTER + b) for b in token) for token in coder.tokens]
    assert coder.processor.encode(mapped) == [[i] for i in range(len(mapped))]


def test_byte_bpe_query_on_documents(spark):
    known = _tiktoken()
    docs = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    rows = queries.op2_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in rows} == set(docs)
    for row in rows:
        ids = known.encode_ordinary(docs[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(docs[row["doc_id"]].encode()).hexdigest()


def _expected_files(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    start, out = 0, []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_query_on_documents(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").orderBy("doc_id").collect()
    rows = queries.op9_token_files(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == _expected_files([tuple(r) for r in docs])


def test_token_files_of_odd_rows(spark, odd):
    read = token_files.token_files(odd, P.path("word_bpe_49k.json"), 1, spark).orderBy("start").collect()
    expected = _expected_files(sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))
    assert [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in read] == expected
    assert token_files.token_files(odd.limit(0), P.path("word_bpe_49k.json"), 1, spark).count() == 0


def test_token_encoder_takes_fewer_python_steps_than_a_block_has_different_pieces():
    words = [a + b + c for a in ("st", "ré", "lo", "ming", "tra", "ß") for b in ("an", "ei", "ou", "ut") for c in "abcdefghijklmnopqrstuvwxyz"]
    forms = [f(w) + m for w in words for f in (str, str.title, str.upper) for m in ("", ".", ",", "!", "?", ";", ":", ").", "...")]
    texts = [" ".join(forms[i::50]) + "\n" for i in range(50)] + ["don't 3,4 (a) x" + forms[0], None, ""]
    encoder = token_files.Encoder(P.path("word_bpe_49k.json"))
    steps = cProfile.Profile()
    ids, ends = steps.runcall(encoder.encode, pa.array(texts, pa.string()))
    assert [part.tolist() for part in np.split(ids, ends)][:-1] == [
        e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    ]
    assert sum(e.callcount for e in steps.getstats()) < len(set(forms)) // 2


@pytest.mark.parametrize("values", [[], [0], [0, 0, 5, 5, 5, 1000], list(range(3000)), [7**i for i in range(22)], [0] * 600 + [1 << 40]])
def test_elias_fano_selects_every_value(values):
    coded = token_files.EliasFano.encode(np.array(values, np.uint64))
    again, end = token_files.EliasFano.parse(b"xx" + coded.tobytes(), 2)
    assert end == 2 + len(coded.tobytes())
    assert again.values(0, len(values)).tolist() == values
    assert [again.select(i) for i in range(len(values))] == values
    if len(values) > 1000:  # two bits and the low bits for each, and samples
        assert 8 * len(coded.tobytes()) < len(values) * (coded.low_bits + 2.3) + 300


def test_archive_rebuilds_records(spark):
    big, small = "x" * 1500, "y" * 999
    rows = [
        (1, "http://a/\r\nX: 1", big, "p"), (2, None, big, "p"), (9, "http://b/", big, "p"), (3, "http://c/", small, "p"), (4, "http://d/", small, "p"),
        (5, "http://e/", None, None), (6, "http://f/", "", "p"), (7, "http://g/", "é" * 500, "p"), (8, "http://h/", "é" * 500, "p"), (None, "http://i/", big, "p"), (9, "http://b/", big, "p"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    archive = warc_archive.write_archive(pages, shared_folder(spark, "warc-test"))
    assert archive.payloads.count() == 4
    records = warc_archive.read_archive(archive).collect()
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in records)
    assert got == sorted([
        (1, "revisit", 9, 1500), (2, "revisit", 9, 1500), (9, "response", None, 1500), (9, "response", None, 1500), (3, "response", None, 999),
        (4, "response", None, 999), (5, "response", None, 0), (6, "response", None, 0), (7, "revisit", 8, 1000), (8, "response", None, 1000), (0, "revisit", 9, 1500),
    ])
    for r in records:
        assert r["payload_digest"] == hashlib.sha1(bytes(r["payload"])).hexdigest()
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(head.decode().split("Content-Length: ")[1].split("\r\n")[0])
        assert block[length:] == b"\r\n\r\n"
        assert block[:length].endswith(bytes(r["payload"]) if r["record_type"] == "response" else b"\r\n\r\n")
    assert warc_archive.archive_pages(pages.limit(0)).count() == 0


def test_damaged_payload_is_an_error(spark):
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    archive = warc_archive.write_archive(pages, shared_folder(spark, "warc-damaged"))
    archive.payloads.selectExpr("payload_key", "cast('abd' as binary) as payload").write.parquet(f"{archive.folder}/other/payloads")
    archive.headers.write.parquet(f"{archive.folder}/other/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc_archive.read_archive(warc_archive.Archive(spark, f"{archive.folder}/other")).collect()

"""Operator 13 against the library that its rank file is made for."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"
PATH, PATTERN = queries.byte_bpe_file()


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.tokenizer(PATH, PATTERN)


def ids_of(bpe, texts):
    out = [[] for _ in texts]
    for i, words in bpe.encode(texts):
        out[i] += [int(x) for ids, _ in words for x in ids.split(",")]
    return out


def test_query_equals_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_words_of_every_length_and_script(library, bpe):
    rng = random.Random(5)
    texts = ["a" * 999, "ab" * 400, " " * 700 + "x", "!" * 333, "<|endoftext|>", "don't'll", "\x1c\x85 a", "é", "👩‍👩‍👧 ok", "\n\n \n"]
    texts += ["".join(rng.choice("thanereiou") for _ in range(n)) for n in range(1, 120)]
    texts += ["".join(rng.choice("abcdeéñß中文字เดсло123 ") for _ in range(400)) for _ in range(20)]
    texts += ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300))]
    got = ids_of(bpe, texts)
    assert got == library.encode_ordinary_batch(texts)
    assert bpe.decode([byte_bpe.np.array(x) for x in got]) == [t.encode() for t in texts]


def test_every_low_code_point(library, bpe):
    texts = [f"a{chr(c)}{chr(c)} {chr(c)}1" for c in range(0x2100)]
    assert ids_of(bpe, texts) == library.encode_ordinary_batch(texts)


def test_memory_is_bounded_and_blocks_join(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_WORDS", 7)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(byte_bpe, "MEMORY_BYTES", 3000)
    monkeypatch.setattr(byte_bpe, "QUERY_BYTES", 64)
    monkeypatch.setattr(byte_bpe, "ROUNDS", 2)
    small = byte_bpe.RankedBpe(PATH, PATTERN)
    texts = [" ".join(f"word{i * j % 101} qzx{i}" for i in range(j * 5)) for j in range(9)] + ["q" * 300]
    assert ids_of(small, texts) == library.encode_ordinary_batch(texts)
    assert len(small.known) < 60
    table = byte_bpe._digest(small, texts)
    assert list(table.ids_sha256) == [hashlib.sha256(",".join(map(str, library.encode_ordinary(t))).encode()).hexdigest() for t in texts]
    assert list(table.decoded_sha256) == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_round_trip_and_edges(spark, docs, nothing, clashing):
    encoded = byte_bpe.encode_documents(docs, PATH, PATTERN)
    for r in byte_bpe.decode_documents(encoded, PATH, PATTERN).collect():
        assert bytes(r.decoded).decode() == (r.text or "") and r.n_tokens == len(r.ids)
    assert byte_bpe.digest_documents(nothing, PATH, PATTERN).count() == 0 and byte_bpe.encode_documents(nothing, PATH, PATTERN).count() == 0
    own = {(r.doc_id, r.ids_sha256) for r in byte_bpe.digest_documents(docs, PATH, PATTERN).collect()}
    same = byte_bpe.digest_documents(clashing, PATH, PATTERN)
    assert {(r.doc_id, r.ids_sha256) for r in same.collect()} == own and same.columns[:5] == docs.columns
    empty = byte_bpe.digest_documents(docs.where(F.col("text").isNull()), PATH, PATTERN).first()
    assert (empty.n_tokens, empty.ids_sha256, empty.decoded_sha256) == (0, hashlib.sha256().hexdigest(), hashlib.sha256().hexdigest())

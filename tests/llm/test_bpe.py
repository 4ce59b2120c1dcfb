from __future__ import annotations

import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from snapdelta.llm import bpe
from snapdelta.llm.common import tokenizer

PATH, PATTERN = tokenizer()


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts(n=150):
    rng = random.Random(8)
    pool = "abe thè 12'sré\n\t  !?中😀  \x1c\x85"
    out = [None, "", " ", "<|endoftext|>", "a" * 700, " " * 900, "word " * 200, "don't we'll I'M", "x" * 300 + " " * 200 + "y"]
    return out + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 400))) for _ in range(n)]


def test_chunks_give_the_ids_of_the_whole(frame, reference):
    rows = list(enumerate(texts()))
    for chunk, overlap in ((64, 16), (50, 50), (16_384, 512)):
        got = {r.doc_id: r.ids for r in bpe.encoded(frame(rows), PATH, PATTERN, chunk=chunk, overlap=overlap).collect()}
        for doc_id, text in rows:
            assert got[doc_id] == reference.encode_ordinary(text or ""), (chunk, text)


def test_very_long_text_and_round_trip(frame, reference):
    rng = random.Random(1)
    text = "".join(rng.choice(["the ", "über ", "\n", "12345", "q" * 3_000, "  "]) for _ in range(3_000))
    coded = bpe.encoded(frame([(1, text), (2, text), (2, text), (None, "é")]), PATH, PATTERN)
    back = bpe.decoded(coded, PATH).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted([text.encode()] * 3 + ["é".encode()])
    assert next(r.ids for r in back if r.doc_id == 1) == reference.encode_ordinary(text)


def test_long_pieces_merge_in_the_same_order(reference):
    ranks, rng = bpe.read_ranks(PATH), random.Random(2)
    for n in (49, 60, 200, 1_500):
        piece = "".join(rng.choice("abteh") for _ in range(n))
        assert bpe.merge(piece.encode(), ranks) == reference.encode_ordinary(piece)


def test_empty_table_and_extra_columns(frame):
    assert bpe.encoded(frame([]), PATH, PATTERN).count() == 0
    docs = frame([(1, "a b")]).withColumn("ids", F.lit(3)).withColumn("row", F.lit(1)).withColumn("piece", F.lit("x"))
    assert bpe.encoded(docs, PATH, PATTERN).columns == ["doc_id", "ids"]
    assert bpe.decoded(bpe.encoded(docs, PATH, PATTERN), PATH).first().bytes == bytearray(b"a b")


def test_own_bytes_are_replaced(frame):
    coded = bpe.encoded(frame([(1, "a b")]), PATH, PATTERN).withColumn("bytes", F.lit("own"))
    assert bpe.decoded(coded, PATH).select("doc_id", "bytes").first() == (1, bytearray(b"a b"))

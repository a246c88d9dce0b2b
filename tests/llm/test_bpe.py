"""Encoding against the library; decoding by round trip."""

from __future__ import annotations

import base64
from array import array

import public_tokenizers
import pytest

import corpus_pipeline as C
from tallyforge.llm import bpe

RANKS = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
TEXTS = [
    "", None, "a", "Hello world, it's 2024!  We'll see.\n\n\n", "日本語の文章がここにあります。" * 40, "x" * 700, "word " * 300, " " * 500, "12345 67890 " * 60, "don't 're\n" * 80,
    "ñandú ½ Ⅷ 🙂🙂 \t mixed\r\n" * 30, "<|endoftext|> not special " * 20, "aé" * 400, "a. \n b" * 200,
]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS), (64, 16), (37, 5)])
def test_equals_the_library(spark, library, chunk, overlap):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "x"), (None, TEXTS[6], "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk_chars=chunk, overlap_chars=overlap)
    got = sorted((str(r["id"]), list(array("I", bytes(r["ids"]))), bytes(r["decoded"])) for r in bpe.decode(encoded, RANKS).collect())
    assert got == sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)


@pytest.mark.parametrize(("chunk", "overlap"), [(bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS), (64, 16)])
def test_decoded_by_the_worker_that_encodes(spark, chunk, overlap):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(6, TEXTS[6]), (None, TEXTS[6]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain, both = (bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk_chars=chunk, overlap_chars=overlap, decoded=d) for d in (False, True))
    apart = bpe.decode(plain, RANKS)
    assert both.schema == apart.schema and sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))
    workers = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert workers(C.tokenise(spark, docs, "")) == workers(bpe.encode(docs, RANKS, public_tokenizers.PATTERN))


def test_ids_as_integers(spark, library):
    docs = spark.createDataFrame([(1, TEXTS[3]), (2, "")], "doc_id bigint, text string")
    rows = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).select("id", bpe.token_ids().alias("t")).collect()
    assert {r["id"]: r["t"] for r in rows} == {1: library.encode_ordinary(TEXTS[3]), 2: []}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.decode(bpe.encode(none, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0

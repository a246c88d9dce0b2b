"""Registered queries over one small corpus of odd texts: against the libraries, or their SQL."""

from __future__ import annotations

import base64
import hashlib
import random
import struct

import duckdb
import pytest

import public_tokenizers as P
from tallyforge.llm import registry
from tests.llm import corpus as small


@pytest.fixture(scope="module")
def docs():
    return small.texts(9) | {400: "don't  stop\n\n now 12345 <|endoftext|> é", 401: "ab" * 70_000, 402: " " * 40_000 + "x"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs):
    rng = random.Random(2)
    items = [(i, " ".join(docs[203].split()[i * 50 : i * 50 + 30])) for i in range(40)] + [(90, None), (91, ""), (92, "a"), (93, docs[3]), (None, docs[3]), (93, docs[3])]
    items += [(100 + i, small.prose(rng, 20)) for i in range(20)]
    return small.written(spark, tmp_path_factory.mktemp("contract"), docs, benchmark=(items, "item_id bigint, text string"))


def answer(spark, folder, name):
    rows = registry.queries()[name](spark, folder).collect()
    return {r["doc_id"]: r for r in rows}, rows


def test_op5_equals_the_library(spark, folder, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got, rows = answer(spark, folder, "op5_bpe")
    assert len(rows) == len(docs) == len(got)
    for i, text in docs.items():
        ids = library.encode_ordinary(text or "")
        want = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want


def test_op8_equals_the_library(spark, folder, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got, rows = answer(spark, folder, "op8_token_count")
    assert len(rows) == len(docs) == len(got)
    for i, text in docs.items():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 1024)


@pytest.mark.parametrize("name", ["op2_sharding", "op3_decontaminate"])
def test_equals_its_sql(spark, folder, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    theirs = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    ours = registry.queries()[name](spark, folder)
    assert sorted(columns) == sorted(ours.columns)
    assert sorted(str(tuple(r)) for r in ours.select(*columns).collect()) == sorted(map(str, theirs.fetchall()))


def test_op2_keeps_its_law(spark, folder, docs):
    got, rows = answer(spark, folder, "op2_sharding")
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert got.keys() == docs.keys() and sorted(slots) == list(range(8)) and {r["law"] for r in rows} == {"rows"}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1

"""Token counts against the library."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

from tallyforge.llm import token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def blob():
    with open(PATH, "rb") as file:
        return file.read()


def texts():
    rng = random.Random(2)
    alphabet = "aaab cd  \n\t'sélñ12½日🙂<|>."
    fixed = ["", "aaaaaaaaaaaaa", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext|", "  \n\n x\t\ty  ", "日本語テキスト 12345", "it's I'LL we're", "🙂🙂 é" * 5, "a" * 5000, "ab" * 3000, " " * 300]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]


def test_counts_equal_the_library(spark, blob):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rows = [(i, t, 9) for i, t in enumerate(texts())] + [(None, None, 9), (3, "again", 9)]
    counted = token_count.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int"), blob).collect()
    got = sorted((str(r["id"]), r["n_bytes"], r["n_tokens"]) for r in counted)
    assert got == sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)


def test_long_texts_are_cut_where_pre_tokens_end(blob, monkeypatch):
    merger = token_count.Merger(blob)
    sample = [t * 40 for t in texts()[:60]]
    whole = merger.count_batch(sample)
    monkeypatch.setattr(token_count, "PART_CHARS", 50)
    monkeypatch.setattr(token_count, "REMEMBERED", 20)
    assert token_count.Merger(blob).count_batch(sample) == whole


def test_empty_table(spark, blob):
    assert token_count.count_tokens(spark.createDataFrame([], "doc_id bigint, text string"), blob).count() == 0

"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

The distinct new pre-tokens of a batch are laid end to end in one numpy array of
symbols. In each round every sequence finds the lowest merge rank among its pairs,
and all sequences merge theirs at once; finished sequences leave. What survives is
counted. Counts of pre-tokens are remembered in each worker up to a fixed number.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pre-tokens that a worker remembers; beyond it, it starts anew.
REMEMBERED = 500_000
#: Characters of a text that are split at a time; cuts fall where a pre-token must end.
PART_CHARS = 1 << 20
#: Pre-tokens merged at a time.
MERGE_AT = 100_000

# Fixed value: the byte-level split pattern of this family of tokenizers.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = np.iinfo(np.int64).max


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte: printable ones for themselves, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merger:
    """Counts the symbols that a merge table leaves of byte strings."""

    def __init__(self, blob: bytes):
        config = json.loads(blob)
        model, split = config["model"], config["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or config["normalizer"]:
            raise ValueError("not a plain byte-level BPE file")
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        names = byte_symbols()
        self.of_byte = np.array([vocab[names[b]] for b in range(256)], dtype=np.int64)
        self.specials = [t["content"] for t in config["added_tokens"]]
        self.counts: dict[str, int] = {}
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.firm = regex.compile(r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]")

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that each word ends with."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = lengths.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        if not len(symbols):
            return counts
        rank = np.full(len(symbols), NEVER)
        same = owner[1:] == owner[:-1]
        rank[:-1][same] = self._rank(symbols[:-1][same], symbols[1:][same])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.append(starts, len(symbols)))
            lowest = np.minimum.reduceat(rank, starts)
            counts[owner[starts]] = size
            going = lowest < NEVER
            if not going.any():
                break
            if not going.all():
                stay = np.repeat(going, size)
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                size, lowest = size[going], lowest[going]
            at = np.flatnonzero(rank == np.repeat(lowest, size))
            # Equal pairs that overlap, as in "aaa", merge from the left: every other one of a run.
            fresh = np.concatenate(([True], np.diff(at) != 1))
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = at - np.searchsorted(at, at)  # each earlier merge removed one symbol
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            changed = np.unique(np.concatenate((at, at[at > 0] - 1)))
            rank[changed] = NEVER
            inner = changed[changed < len(symbols) - 1]
            inner = inner[owner[inner] == owner[inner + 1]]
            rank[inner] = self._rank(symbols[inner], symbols[inner + 1])
        return counts

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.counts]
        for i in range(0, len(new), MERGE_AT):
            part = new[i : i + MERGE_AT]
            self.counts.update(zip(part, self.merge([w.encode() for w in part]).tolist()))

    def parts(self, text: str):
        """Stretches of a text that no pre-token crosses, and the number of special tokens between."""
        plain = self.special.split(text) if self.special else [text]
        for piece in plain:
            while len(piece) > PART_CHARS:
                cut = self.firm.search(piece, PART_CHARS)
                if cut is None:
                    break
                yield piece[: cut.start()]
                piece = piece[cut.start() :]
            yield piece

    def count_batch(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out, waiting, unknown = [0] * len(texts), [], set()

        def settle():
            self.learn(unknown)
            for row, found in waiting:
                out[row] += sum(map(self.counts.__getitem__, found))
            waiting.clear()
            unknown.clear()
            if len(self.counts) > REMEMBERED:
                self.counts.clear()

        held = 0
        for row, text in enumerate(texts):
            if self.special:
                out[row] += len(self.special.findall(text))
            for piece in self.parts(text):
                found = self.split.findall(piece)
                waiting.append((row, found))
                unknown.update(found)
                held += len(found)
                if held > 10 * MERGE_AT:
                    settle()
                    held = 0
        settle()
        return out


_MERGERS: dict[tuple, Merger] = {}


def _merger(blob: bytes) -> Merger:
    key = (len(blob), zlib.crc32(blob))
    if key not in _MERGERS:
        _MERGERS[key] = Merger(blob)
    return _MERGERS[key]


def count_tokens(docs: DataFrame, tokenizer: bytes, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_bytes`` and ``n_tokens`` of every row's whole text, special strings as one token.

    ``tokenizer`` is the content of a byte-level BPE ``tokenizer.json``; it is
    broadcast, and its size is that of the file. Null texts count as empty; ids may be
    null or repeated; an empty table gives no rows; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    rows = docs.select(F.col(f"`{row_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    wanted = rows.select("id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema
    schema = to_arrow_schema(wanted)

    def run(batches):
        merger = _merger(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column("text").to_pylist()
                counts = merger.count_batch(texts)
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("id").cast(schema.field("id").type), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], schema=schema)

    return rows.mapInArrow(run, wanted)


def op8_token_count(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    """Token counts of every document by the 50k byte-level vocabulary."""
    import public_tokenizers

    from tallyforge.llm.tables import read

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        blob = file.read()
    counted = count_tokens(read(spark, sf_dir, "documents"), blob)
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Byte-level BPE encoding and decoding of whole texts, however long.

Short texts are encoded where they are read. Long ones are cut into overlapping
chunks that are dealt over the cluster and pre-tokenised in parallel. Two
neighbouring chunks are stitched at the first position in their overlap where both
have a pre-token boundary after a letter or a number: no match of the pattern
continues a run of letters or numbers with anything else, so such a boundary holds
wherever matching began, and the text from there on is split alike. Pieces between
stitches are encoded apart and their ids concatenated; where an overlap has no such
place, its chunks are joined to one piece. Decoding concatenates the ids' raw bytes.

The vocabulary is read by the driver and broadcast; its size is that of one file.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Bytes of ids or text in one Arrow batch that a task returns.
BATCH_BYTES = 8 << 20

_CODECS: dict[tuple, object] = {}


def _once(kind: str, blob: bytes, make):
    """``make()`` once for each Python worker and vocabulary."""
    key = (kind, len(blob), zlib.crc32(blob))
    if key not in _CODECS:
        _CODECS[key] = make()
    return _CODECS[key]


def _ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}


def _encoder(blob: bytes, pattern: str):
    import tiktoken

    return _once(pattern, blob, lambda: tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=_ranks(blob), special_tokens={}))


def _id_bytes(blob: bytes) -> list[bytes]:
    def make():
        ranks = _ranks(blob)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        return table

    return _once("decode", blob, make)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded bytes; ``size(row)`` is a row's bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row) + 64
        if total >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _arrow(df: DataFrame, columns: list[str]) -> pa.Schema:
    """The Arrow schema of some columns of a DataFrame."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.select(*columns).schema)


def vocabulary(path: str) -> bytes:
    """A rank file's content, read on the driver."""
    with open(path, "rb") as file:
        return file.read()


def _decoding(run, shared, schema: pa.Schema):
    """What ``run`` makes of batches, rows of ``schema`` that end with ``ids``, and then ``decoded``."""
    longer = schema.append(pa.field("decoded", pa.binary()))

    def both(batches):
        table = _id_bytes(shared.value).__getitem__
        for batch in run(batches):
            plain = [c.to_pylist() for c in batch.columns[:-1]]
            rows = ((*row[:-1], ids, b"".join(map(table, array("I", ids)))) for row, ids in ((r, r[-1].as_py()) for r in zip(*plain, batch.columns[-1])))
            yield from _batches(rows, longer, lambda r: len(r[-2]) + len(r[-1]))

    return both


def _mapped(df: DataFrame, run, wanted: DataFrame, shared, decoded: bool) -> DataFrame:
    """``df`` through ``run``, which gives rows like ``wanted``, in one Python worker a task; with ``decoded`` at their end if asked for."""
    if not decoded:
        return df.mapInArrow(run, wanted.schema)
    run = _decoding(run, shared, _arrow(wanted, wanted.columns))
    return df.mapInArrow(run, wanted.withColumn("decoded", F.col("ids")).schema)


def _encode_texts(df: DataFrame, shared, pattern: str, text: str, decoded: bool = False) -> DataFrame:
    """``df`` with its text column replaced by ``ids`` (little-endian unsigned 32-bit)."""
    others = [c for c in df.columns if c != text]
    schema = _arrow(df, others).append(pa.field("ids", pa.binary()))

    def run(batches):
        encode = _encoder(shared.value, pattern).encode_ordinary
        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in others]
            rows = zip(*plain, batch.column(text))
            yield from _batches(((*row[:-1], array("I", encode(row[-1].as_py())).tobytes()) for row in rows), schema, lambda r: len(r[-1]))

    wanted = df.select(*others, F.lit(None).cast("binary").alias("ids"))
    return _mapped(df.select(*others, text), run, wanted, shared, decoded)


def _cut(df: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(id, key, text) as chunks (key, id, k, text) with ``overlap`` more characters each."""
    schema = _arrow(df, ["key", "id"]).append(pa.field("k", pa.int64())).append(pa.field("text", pa.string()))

    def run(batches):
        for batch in batches:

            def rows():
                for key, ident, value in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), batch.column("text")):
                    whole = value.as_py()
                    for k in range(-(-len(whole) // chunk)):
                        yield key, ident, k, whole[k * chunk : (k + 1) * chunk + overlap]

            yield from _batches(rows(), schema, lambda r: len(r[-1]))

    return df.mapInArrow(run, df.select("key", "id", F.lit(0).cast("long").alias("k"), "text").schema)


def _boundaries(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, k, head, tail): the places in the whole text where pre-tokens end after a letter
    or number, in a chunk's first ``overlap`` characters and in those it shares with the next."""
    schema = pa.schema([pa.field("key", pa.string()), pa.field("k", pa.int64()), pa.field("head", pa.list_(pa.int64())), pa.field("tail", pa.list_(pa.int64()))])

    def run(batches):
        compiled, firm = regex.compile(pattern), regex.compile(r"[\p{L}\p{N}]")
        for batch in batches:

            def rows():
                for key, k, value in zip(batch.column("key").to_pylist(), batch.column("k").to_pylist(), batch.column("text")):
                    part = value.as_py()
                    ends = [m.end() for m in compiled.finditer(part)]
                    ends = [p for p in ends if (p <= overlap or p >= chunk) and p < len(part) and firm.match(part, p - 1)]
                    yield key, k, [k * chunk + p for p in ends if p <= overlap], [k * chunk + p for p in ends if p >= chunk]

            yield from _batches(rows(), schema, lambda r: 16 * (len(r[2]) + len(r[3])))

    return chunks.select("key", "k", "text").mapInArrow(run, "key string, k long, head array<long>, tail array<long>")


def _pieces(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, run, id, copies, text): texts between the places where neighbours resynchronise."""
    by_key = Window.partitionBy("key").orderBy("k")
    marks = (
        _boundaries(chunks, pattern, chunk, overlap)
        .withColumn("sync", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(by_key), F.col("head")))))
        .withColumn("run", F.count("sync").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("next_sync", F.lead("sync").over(by_key))
        .withColumn("last", F.lead("k").over(by_key).isNull())
        .withColumn("run_chunks", F.count(F.lit(1)).over(Window.partitionBy("key", "run")))
        .select("key", "k", "run", "run_chunks", F.coalesce("sync", F.col("k") * chunk).alias("from"), F.when(~F.col("last"), F.coalesce("next_sync", (F.col("k") + 1) * chunk)).alias("to"))
    )
    start = F.col("from") - F.col("k") * chunk + 1
    stop = F.when(F.col("to").isNull(), F.length("text")).otherwise(F.col("to") - F.col("k") * chunk)
    parts = chunks.join(marks, ["key", "k"]).withColumn("text", F.substring("text", start.cast("int"), (stop - start + 1).cast("int")))
    alone = parts.where("run_chunks = 1").select("key", "run", "id", "copies", "text")
    glued = (
        parts.where("run_chunks > 1")
        .groupBy("key", "run")
        .agg(F.first("id").alias("id"), F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("k", "text"))).alias("all"))
        .select("key", "run", "id", "copies", F.array_join("all.text", "").alias("text"))
    )
    return alone.unionByName(glued)


def _gather(encoded: DataFrame, shared, decoded: bool) -> DataFrame:
    """(id, copies, ids) of each text from its pieces, read in order and never held twice."""
    schema = _arrow(encoded, ["id", "copies", "ids"])

    def run(batches):
        def rows():
            key, row, ids = None, None, []
            for batch in batches:
                for k, ident, copies, value in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "copies")), batch.column("ids")):
                    if k != key:
                        if ids:
                            yield *row, b"".join(ids)
                        key, row, ids = k, (ident, copies), []
                    ids.append(value.as_py())
            if ids:
                yield *row, b"".join(ids)

        yield from _batches(rows(), schema, lambda r: len(r[-1]))

    ordered = encoded.repartition("key").sortWithinPartitions("key", "run")
    return _mapped(ordered, run, encoded.select("id", "copies", "ids"), shared, decoded)


def encode(docs: DataFrame, ranks: bytes, pattern: str, row_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, decoded: bool = False) -> DataFrame:
    """``id`` and ``ids`` (binary: little-endian unsigned 32-bit) of every row's whole text.

    With ``decoded``, also what ``decode`` makes of the ids, by the worker that has them,
    so a task has one Python worker and not two.
    A null text encodes as an empty one. Ids need not be unique or present; each input
    row gives one output row. An empty table gives no rows. Only the two named columns
    are read, so other columns cannot clash.
    """
    if overlap_chars >= chunk_chars:
        raise ValueError("the overlap must be shorter than the chunk")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(F.col(f"`{row_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    short = _encode_texts(rows.where(F.length("text") <= chunk_chars), shared, pattern, "text", decoded)
    long = rows.where(F.length("text") > chunk_chars)
    key = F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit("\n"), F.col("text")), 256)
    # Equal rows have equal chunks: they are encoded once and counted.
    chunks = (
        _cut(long.select(key.alias("key"), "id", "text"), chunk_chars, overlap_chars)
        .groupBy("key", "k")
        .agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    )
    whole = _gather(_encode_texts(_pieces(chunks, pattern, chunk_chars, overlap_chars), shared, pattern, "text"), shared, decoded)
    return short.unionByName(whole.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_", "copies"))


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """``id``, ``ids`` and ``decoded`` (the raw bytes of the ids, concatenated)."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    rows = encoded.select("id", "ids")
    return _mapped(rows, iter, rows, shared, True)


def token_ids(ids: str = "ids") -> Column:
    """Ids as an array of integers, from their bytes."""
    groups = F.regexp_extract_all(F.hex(F.col(ids)), F.lit("(.{8})"), F.lit(1))
    return F.transform(groups, lambda g: F.conv(F.concat(*[F.substring(g, 7 - 2 * b, 2) for b in range(4)]), 16, 10).cast("int"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document by the multilingual rank file."""
    import public_tokenizers

    from tallyforge.llm.tables import read

    ranks = vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decode(encoded, ranks).select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

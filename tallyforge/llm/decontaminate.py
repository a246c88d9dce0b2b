"""Benchmark decontamination by a prefix-filtered join of word shingles.

A window is ``window`` consecutive words of a benchmark item (the whole item where
it is shorter). A document holds a window only if it holds every word shingle of
it, so a necessary prefix of one shingle is enough: shingles are ordered by the
number of documents that hold them, over the whole corpus, and a window is found
through its rarest. Each place of that shingle in a document gives the one place
where the window can start; it must lie within the document (length and position
bound), and the words there are then compared with the window's.

A benchmark of up to ``BLOCK_BYTES`` of text is broadcast as an index. A larger one is
joined by shuffle, with the same result: documents are scanned once for the shingles
that the benchmark has and once for those that windows stand under, each time through
a broadcast bit filter of bounded size, and only what passes it moves.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 10
SHINGLE = 3
#: Text bytes of benchmark items in one broadcast index.
BLOCK_BYTES = 32 << 20
#: The least and most bits of a filter of shingles, as powers of two, and its bits for each shingle between.
FEWEST_BITS, MOST_BITS, BITS_EACH = 16, 26, 16
#: Document words looked at together in a worker.
WORDS_AT_ONCE = 400_000
#: Rows of candidates that a worker holds.
ROWS_AT_ONCE = 2_000

#: On UTF-8 after A-Z are lower-cased: runs of a-z, 0-9 and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """The words of a text; none for null."""
    return [] if text is None else WORD.findall(text.encode().lower())


class Index:
    """Windows of benchmark items and the shingles to find them by."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.windows = list(found)
        self.items = [sorted(found[w]) for w in self.windows]
        self.base = np.uint64(len(self.vocab) + 1)
        #: Shingle length to the sorted keys of all shingles of that length.
        self.keys: dict[int, np.ndarray] = {}
        parts: dict[int, list[tuple[int, ...]]] = {}
        for w in self.windows:
            size = min(shingle, len(w))
            parts.setdefault(size, []).extend(w[i : i + size] for i in range(len(w) - size + 1))
        for size, list_ in parts.items():
            self.keys[size] = np.unique(self.key(np.array(list_, dtype=np.uint64).T))
        self.shingle = shingle
        #: Set by ``order``: shingle length to (sorted keys, first entry of each, window and offset of each entry).
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def key(self, columns) -> np.ndarray:
        """A 64-bit mix of word ids at consecutive places; equal shingles have equal keys."""
        mixed = np.zeros(len(columns[0]), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for column in columns:
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64)
                mixed ^= mixed >> np.uint64(29)
        return mixed

    def order(self, held_by: dict[int, np.ndarray]) -> None:
        """Puts each window under its rarest shingle; ``held_by`` has documents per shingle."""
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for number, w in enumerate(self.windows):
            size = min(self.shingle, len(w))
            ids = np.array(w, dtype=np.uint64)
            keys = self.key([ids[i : len(w) - size + 1 + i] for i in range(size)])
            at = np.searchsorted(self.keys[size], keys)
            best = int(np.argmin(held_by[size][at]))
            entries.setdefault(size, []).append((int(at[best]), number, best))
        for size, rows in entries.items():
            table = np.array(sorted(rows), dtype=np.int64)
            used, first = np.unique(table[:, 0], return_index=True)
            self.prefix[size] = (self.keys[size][used], np.append(first, len(table)), table[:, 1], table[:, 2])
        self.sizes = np.array([len(w) for w in self.windows], dtype=np.int64)
        longest = int(self.sizes.max()) if len(self.windows) else 0
        self.table = np.zeros((len(self.windows), longest), dtype=np.int64)
        for i, w in enumerate(self.windows):
            self.table[i, : len(w)] = w


def _groups(texts, vocab):
    """Runs of documents as (first row, word ids with a 0 after each document, document starts, word counts)."""
    get, first, ids, starts, counts, held = vocab.get, 0, [], [], [], 0
    for row, value in enumerate(texts):
        found = words(value.as_py())
        ids.append(np.fromiter(map(get, found, repeat(0)), np.int64, len(found)))
        ids.append(np.zeros(1, np.int64))
        starts.append(held)
        counts.append(len(found))
        held += len(found) + 1
        if held >= WORDS_AT_ONCE:
            yield first, np.concatenate(ids), np.array(starts), counts
            first, ids, starts, counts, held = row + 1, [], [], [], 0
    if starts:
        yield first, np.concatenate(ids), np.array(starts), counts


def _places(index: Index, ids: np.ndarray, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``size`` known words stand whose key is among ``keys``, and its number."""
    if len(ids) < size or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = ids > 0
    full = known[: len(ids) - size + 1].copy()
    for i in range(1, size):
        full &= known[i : len(ids) - size + 1 + i]
    at = np.flatnonzero(full)
    mixed = index.key([ids[at + i] for i in range(size)])
    slot = np.minimum(np.searchsorted(keys, mixed), len(keys) - 1)
    ok = keys[slot] == mixed
    return at[ok], slot[ok]


def _find(index: Index, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start place, window) of every occurrence of a window."""
    starts, windows = [], []
    for size, (keys, first, window, offset) in index.prefix.items():
        at, slot = _places(index, ids, keys, size)
        many = first[slot + 1] - first[slot]
        entry = np.repeat(first[slot], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        start, which = np.repeat(at, many) - offset[entry], window[entry]
        length = index.sizes[which]
        inside = (start >= 0) & (start + length <= len(ids))
        start, which, length = start[inside], which[inside], length[inside]
        for i in range(index.table.shape[1]):  # a 0 between documents equals no word
            fits = (length <= i) | (ids[np.minimum(start + i, len(ids) - 1)] == index.table[which, i])
            start, which, length = start[fits], which[fits], length[fits]
        starts.append(start)
        windows.append(which)
    return (np.concatenate(starts), np.concatenate(windows)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _held_by(docs: DataFrame, shared) -> dict[int, np.ndarray]:
    """Documents per shingle of the index, over all documents."""
    schema = pa.schema([pa.field("size", pa.int32()), pa.field("slot", pa.int64()), pa.field("n", pa.int64())])

    def run(batches):
        index = shared.value
        totals = {size: np.zeros(len(keys), np.int64) for size, keys in index.keys.items()}
        for batch in batches:
            for _, ids, starts, _ in _groups(batch.column("text"), index.vocab):
                for size, keys in index.keys.items():
                    at, slot = _places(index, ids, keys, size)
                    doc = np.searchsorted(starts, at, side="right")
                    once = np.unique(doc * np.int64(len(keys) + 1) + slot) % np.int64(len(keys) + 1)
                    totals[size] += np.bincount(once, minlength=len(keys))
        for size, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(at), pa.array(n[at])], schema=schema)

    rows = docs.select("text").mapInArrow(run, "size int, slot long, n long").groupBy("size", "slot").agg(F.sum("n").alias("n"))
    held = {size: np.zeros(len(keys), np.int64) for size, keys in shared.value.keys.items()}
    for size, slot, n in rows.collect():  # at most one row for each shingle of the broadcast block
        held[size][slot] = n
    return held


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    """``docs`` (id, key, text) as (id, key, n_words, spans, items)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(index)
    index.order(_held_by(docs, shared))
    shared.unpersist()
    shared = spark.sparkContext.broadcast(index)
    empty = "cast(null as {})"
    wanted = docs.select("id", "key", F.lit(0).cast("long").alias("n_words"), F.expr(empty.format("array<struct<start:long,end:long>>")).alias("spans"), F.expr(empty.format("array<string>")).alias("items")).schema
    schema = to_arrow_schema(wanted)

    def run(batches):
        index = shared.value
        for batch in batches:
            for first, ids, starts, counts in _groups(batch.column("text"), index.vocab):
                part = batch.slice(first, len(counts))
                spans, items = [[] for _ in counts], [set() for _ in counts]
                start, which = _find(index, ids)
                order = np.argsort(start, kind="stable")
                start, which = start[order], which[order]
                doc = np.searchsorted(starts, start, side="right") - 1
                for row, s, w in zip(doc.tolist(), (start - starts[doc]).tolist(), which.tolist()):
                    items[row].update(index.items[w])
                    end, own = s + len(index.windows[w]), spans[row]
                    if own and s <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], end)
                    else:
                        own.append({"start": s, "end": end})
                columns = [part.column("id").cast(schema.field("id").type), part.column("key").cast(schema.field("key").type), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, schema.field("spans").type), pa.array([sorted(i) for i in items], schema.field("items").type)], schema=schema)

    return docs.mapInArrow(run, wanted)


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item, window, size) of every window of the items; a window is its words joined by spaces."""
    def run(batches):
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text")):
                own = words(text.as_py())
                size = min(window, len(own))
                found = {b" ".join(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
                out[0].extend([item] * len(found))
                out[1].extend(w.decode() for w in found)
                out[2].extend([size] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())], names=["item", "window", "size"])

    return items.select("item", "text").mapInArrow(run, "item string, window string, size int")


def _filter(keys: DataFrame) -> np.ndarray:
    """The bits of a filter that holds the keys; its words reach the driver, 2 ** (MOST_BITS - 6) at most."""
    n = keys.agg(F.approx_count_distinct("key")).first()[0]
    power = min(MOST_BITS, max(FEWEST_BITS, (n * BITS_EACH).bit_length()))
    bit = F.col("key").bitwiseAND(F.lit((1 << power) - 1))
    word = F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("mask")
    rows = keys.select(*word).groupBy("word").agg(F.bit_or("mask").alias("mask")).collect()
    bits = np.zeros(1 << (power - 6), np.int64)
    for r in rows:
        bits[r["word"]] = r["mask"]
    return bits.view(np.uint64)


def _passing(found: list[bytes], sizes: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the shingles of these sizes that pass the filter."""
    from xxhash import xxh64_intdigest

    places, keys = [], []
    for size in sizes:
        n = len(found) - size + 1
        if n > 0:
            runs = found if size == 1 else map(b" ".join, zip(*(found[i:] for i in range(size))))
            keys.append(np.fromiter((xxh64_intdigest(r, 42) for r in runs), np.uint64, n))
            places.append(np.arange(n))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, keys = np.concatenate(places), np.concatenate(keys)
    at = keys & np.uint64(len(bits) * 64 - 1)
    held = bits[at >> np.uint64(6)] >> (keys & np.uint64(63)) & np.uint64(1)
    return places[held > 0], keys[held > 0]


def _shuffled(docs: DataFrame, items: DataFrame, window: int, shingle: int) -> DataFrame:
    """As ``_scan``, for items of any size, by joins of ``docs`` (id, key, text) with the windows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from tallyforge.llm.tables import durable

    every = durable(_windows(items, window))
    windows = every.select("window", "size").distinct()
    sizes = sorted({min(shingle, r["size"]) for r in windows.select("size").distinct().collect()})  # ``window`` sizes at most
    width = F.least(F.lit(shingle), F.col("size"))
    offset = F.posexplode(F.transform(F.sequence(F.lit(1), F.col("size") - width + 1), lambda i: F.xxhash64(F.array_join(F.slice(F.split("window", " "), i, width), " ")))).alias("offset", "key")
    entries = durable(windows.select("window", "size", offset))
    context = docs.sparkSession.sparkContext
    bits = context.broadcast(_filter(entries))

    def held(batches):
        for batch in batches:
            found = [np.unique(_passing(words(v.as_py()), sizes, bits.value)[1]) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], names=["key"])

    counts = docs.select("text").mapInArrow(held, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # A window without a document that has its rarest shingle is in none.
    rarest = entries.join(counts, "key").groupBy("window", "size").agg(F.min(F.struct("n", "key", "offset")).alias("least"), F.count(F.lit(1)).alias("present"))
    prefix = durable(rarest.where(F.col("present") == F.col("size") - width + 1).select("window", "size", "least.key", "least.offset"))
    chosen = context.broadcast(_filter(prefix))
    wanted = docs.select("id", "key", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("shingle"), F.lit(0).cast("long").alias("from"), F.array(F.lit("")).alias("near")).schema
    for field in wanted.fields[2:]:
        field.nullable = True
    schema = to_arrow_schema(wanted)

    def scan(batches):
        for batch in batches:
            rows: list[dict] = []
            for i, (key, value) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text"))):
                own = words(value.as_py())
                rows.append({"i": i, "key": key, "n_words": len(own), "place": None, "shingle": None, "from": None, "near": None})
                places, keys = _passing(own, sizes, chosen.value)
                for place, shingle_key in zip(places.tolist(), keys.view(np.int64).tolist()):
                    begin = max(0, place - window)
                    rows.append({"i": i, "key": key, "n_words": len(own), "place": place, "shingle": shingle_key, "from": begin, "near": [w.decode() for w in own[begin : place + window]]})
                if len(rows) >= ROWS_AT_ONCE:
                    yield part(batch, rows)
                    rows = []
            if rows:
                yield part(batch, rows)

    def part(batch, rows):
        ids = batch.column("id").take(pa.array([r["i"] for r in rows], pa.int64())).cast(schema.field("id").type)
        return pa.RecordBatch.from_arrays([ids, *[pa.array([r[n] for r in rows], schema.field(n).type) for n in schema.names[1:]]], schema=schema)

    found = durable(docs.mapInArrow(scan, wanted))
    start = F.col("place") - F.col("offset")
    own = F.slice("near", (F.col("start") - F.col("from") + 1).cast("int"), F.col("size"))
    hits = found.where(F.col("place").isNotNull()).join(prefix.withColumnRenamed("key", "shingle"), "shingle").withColumn("start", start)
    hits = hits.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    hits = durable(hits.where(F.array_join(own, " ") == F.col("window")).select(F.col("id").alias("_id"), F.col("key").alias("_key"), "start", "size", "window").distinct())
    cells = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))))).alias("cells")
    spans = hits.groupBy("_id", "_key").agg(cells).select("_id", "_key", _runs("cells").alias("spans"))
    named = hits.select("_id", "_key", "window").distinct().join(every.select("window", "item"), "window")
    held_items = named.groupBy(F.col("_id").alias("_id2"), F.col("_key").alias("_key2")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    base = found.where(F.col("place").isNull()).select("id", "key", "n_words")
    same = lambda n: F.col("id").eqNullSafe(F.col(f"_id{n}")) & (F.col("key") == F.col(f"_key{n}"))
    joined = base.join(spans, same(""), "left").join(held_items, same("2"), "left")
    return joined.select("id", "key", "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<start:long,end:long>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def _runs(cells: str):
    """Runs of a sorted array of places as (start, end), end excluded."""
    opens = F.filter(cells, lambda c, i: ~F.get(cells, i - 1).eqNullSafe(c - 1))
    closes = F.filter(cells, lambda c, i: ~F.get(cells, i + 1).eqNullSafe(c + 1))
    return F.transform(opens, lambda a, i: F.named_struct(F.lit("start"), a, F.lit("end"), F.get(closes, i) + 1))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id``, ``key``, ``n_words``, ``spans`` (disjoint word ranges, end excluded) and ``items`` (sorted ids as strings).

    ``key`` is the digest of the text (null for null). A null text has no words; a
    null or wordless item has no window; a null item id reads as an empty string.
    Each input row gives one row, repeated ones too; empty tables give no rows or no
    spans. Only the named columns are read. Benchmarks of more than ``block_bytes`` of
    text are joined by shuffle; documents are scanned twice either way.
    """
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    rows = docs.select(F.col(f"`{row_id}`").alias("id"), F.sha2(F.col(f"`{text}`").cast("string"), 256).alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    if total > block_bytes:
        return _shuffled(rows, items, window, shingle)
    return _scan(rows, Index([(r.item, r.text) for r in items.collect()], window, shingle))  # bounded by block_bytes


def decontaminate(docs: DataFrame, benchmark: DataFrame, **named) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window, columns unchanged.

    Documents are dropped by their text, so their ids need not be unique.
    """
    text = named.get("text", "text")
    hit = find_benchmark(docs, benchmark, **named).where(F.size("spans") > 0).select(F.col("key").alias("_hit")).distinct()
    return docs.join(hit, F.sha2(F.col(f"`{text}`").cast("string"), 256) == hit["_hit"], "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words of every document, by windows of ten words."""
    from tallyforge.llm.tables import read

    found = find_benchmark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "coalesce(regexp_extract_all(" + _LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
OP3_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, w[i:i + least(len(w), {WINDOW}) - 1] AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
places AS (
  SELECT r, i, size, w[i:i + size - 1] AS words
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win))),
hit AS (SELECT p.r, p.i, p.size, win.item_id FROM places p JOIN win ON p.words = win.words),
cells AS (SELECT r, count(DISTINCT c) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS c FROM hit) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cells USING (r) LEFT JOIN found USING (r)
"""

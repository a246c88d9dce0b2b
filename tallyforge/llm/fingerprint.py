"""Document fingerprints: SimHash by weighted term votes, in DataFrame functions alone.

A term is a word and its successor; it weighs its length in bytes, 15 at most. Votes
are counted in packed lanes: the 64 bits of a term's hash are spread over sixteen
longs of four 16-bit lanes, so one aggregation with sixteen sums counts all bits.
A bit of the fingerprint is 1 if terms of over half the weight have it.

Fingerprints within a Hamming radius are found through permuted block tables: the
bits are cut into blocks, and for each choice of blocks as many as the radius, a
table keyed by all other blocks. Two fingerprints within the radius agree on the
key of some table (Manku et al., "Detecting near-duplicates for web crawling").
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.tables import attach, durable, each_copy, read

#: Terms summed in one group of 16-bit lanes: 2048 * 15 is below 2 ** 15, so no sum overflows.
TERMS_PER_GROUP = 2048
MOST_WEIGHT = 15
RADIUS = 3
BLOCKS = 5
#: Rows in a range of ids in which keys are ordered, and the most such ranges; beyond them, ranges grow.
SLICE_ROWS = 100_000
MOST_SLICES = 4_096
#: What names a text: whether its row has an id, the id, and the text's hash.
KEY = ("named", "key_id", "key_text")

# A multiplier that moves bits 0..3 to bits 0, 16, 32, 48, and the mask of those.
SPREAD, LANES = 0x0000200040008001, 0x0001000100010001


def with_words(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``words``: A-Z lower-cased, split at space and \\x09-\\x0D."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.withColumn("words", F.filter(F.split(lowered, r"[ \t-\r]+"), lambda w: w != ""))


def terms(words: Column) -> Column:
    """Every word with its successor; the last word alone. Nothing outside is read in the lambda,
    so an array is split once and not for each of its words."""
    return F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(0))), lambda word, after: F.concat_ws(" ", word, after))


def _votes(rows: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """``key`` and ``fingerprint`` of each row's text; ``key`` must tell the rows apart."""
    exploded = with_words(rows, text).select(*key, F.posexplode_outer(terms(F.col("words"))).alias("nth_term", "term")).select(
        *key,
        F.coalesce(F.floor(F.col("nth_term") / TERMS_PER_GROUP), F.lit(0)).cast("int").alias("part"),
        F.xxhash64("term").alias("h"),
        F.when(F.col("term").isNull(), F.lit(0)).otherwise(F.least(F.octet_length("term"), F.lit(MOST_WEIGHT))).cast("long").alias("w"),
    )
    lanes = [F.sum(((F.shiftrightunsigned("h", 4 * j).bitwiseAND(F.lit(15)) * F.lit(SPREAD)).bitwiseAND(F.lit(LANES))) * F.col("w")).alias(f"s{j}") for j in range(16)]
    grouped = exploded.groupBy(*key, "part").agg(*lanes, F.sum("w").alias("w"))
    # Lanes of 32 bits for the sums over all parts of a text.
    pair = 0x0000FFFF0000FFFF
    even = [F.sum(F.col(f"s{j}").bitwiseAND(F.lit(pair))).alias(f"e{j}") for j in range(16)]
    odd = [F.sum(F.shiftrightunsigned(f"s{j}", 16).bitwiseAND(F.lit(pair))).alias(f"o{j}") for j in range(16)]
    summed = grouped.groupBy(*key).agg(*even, *odd, F.sum("w").alias("w"))
    print_ = None
    for j in range(16):
        for lane in range(4):
            sums = F.col(f"{'eo'[lane % 2]}{j}")
            votes = F.shiftrightunsigned(sums, 32 * (lane // 2)).bitwiseAND(F.lit(0xFFFFFFFF))
            bit = F.shiftleft((votes * 2 > F.col("w")).cast("long"), 4 * j + lane)
            print_ = bit if print_ is None else print_.bitwiseOR(bit)
    return summed.select(*key, print_.alias("fingerprint"))


def fingerprints(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``fingerprint`` (signed long) for each row, repeated ids and rows included.

    A null or wordless text has fingerprint zero; equal texts have equal fingerprints.
    A text may have up to 140 million words; more raise an overflow error.
    """
    slim, texts = _named(docs, row_id, text)
    voted = _votes(texts, KEY, "text")
    return attach(slim, voted.join(slim.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), list(KEY)), KEY, slim.count()).select("id", "fingerprint")


def likeness(a: Column, b: Column) -> Column:
    """The share of bits on which two fingerprints agree."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Keys of the tables: all bits but those of ``radius`` of the blocks."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("there must be more blocks than the radius")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [((1 << 64) - 1) ^ sum(block[i] for i in left_out) for left_out in combinations(range(blocks), radius)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Distinct pairs (``query``, ``fingerprint``) at most ``radius`` bits apart, and ``n`` rows of ``prints`` that have it.

    Both inputs have a column ``fingerprint``; equal values are one row before the
    tables are made, so copies make no pairs. A pair that meets in several tables is
    given by the first of them.
    """
    masks = block_masks(radius, blocks)
    table = F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("table", "mask")
    asked = queries.select(F.col("fingerprint").alias("query")).distinct().select("query", table)
    held = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).select("fingerprint", "n", table)
    asked = asked.select("query", "table", F.col("query").bitwiseAND(F.col("mask")).alias("block"))
    held = held.select("fingerprint", "n", F.col("table").alias("_table"), F.col("fingerprint").bitwiseAND(F.col("mask")).alias("_block"))
    apart = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = None
    for i in reversed(range(len(masks))):
        here = F.when(apart.bitwiseAND(F.lit(_signed(masks[i]))) == 0, F.lit(i))
        first = here if first is None else here.otherwise(first)
    meets = (F.col("table") == F.col("_table")) & (F.col("block") == F.col("_block")) & (F.bit_count(apart) <= radius) & (first == F.col("table"))
    return asked.join(held, meets).select("query", "fingerprint", "n")


def _named(docs: DataFrame, row_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``KEY``, ``n_chars``) of every row, and (``KEY``, ``text``) with each key once; a null text is empty.

    The key is whether there is an id, the id and the text's hash, and sorts as rows do.
    """
    ident = F.col(f"`{row_id}`")
    zero = F.lit(0).cast(docs.schema[row_id].dataType)
    rows = docs.select(ident.alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.col("id").isNotNull().alias("named"), F.coalesce("id", zero).alias("key_id"), F.xxhash64("text").alias("key_text"), F.char_length("text").alias("n_chars"), "text")
    slim = rows.select("id", *KEY, "n_chars")
    texts = rows.select(*KEY, "text")
    repeated = slim.groupBy(*KEY).count().where("count > 1").limit(1).count()
    return slim, texts.dropDuplicates(list(KEY)) if repeated else texts


def in_order(slim: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each distinct key with ``n_chars``, ``copies`` and ``next``, the key after it; the first follows the last.

    Only keys and lengths move. They are ordered within slices of ids, each followed by
    the first key of the next slice; there are ``MOST_SLICES`` at most, and a slice's
    order may spill.
    """
    keys = slim.groupBy(*KEY).agg(F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    slices = max(1, min(MOST_SLICES, slim.count() // slice_rows))
    starts = slim.agg(F.percentile_approx("id", [i / slices for i in range(slices)], 10 * slices)).first()[0] or []
    starts = sorted(set(starts))
    ids = slim.schema["key_id"].dataType
    begins = F.array(*[F.lit(v).cast(ids) for v in starts])
    # Keys without an id are before all others.
    own = F.when(F.col("named"), _at_most(begins, F.col("key_id"), len(starts))).otherwise(F.lit(0)) if starts else F.lit(0)
    keys = durable(keys.withColumn("slice", own))
    at = F.struct(*KEY)
    firsts = keys.groupBy("slice").agg(F.min(at).alias("first"))
    over = Window.orderBy("slice")  # a row for each slice
    after = firsts.select("slice", F.coalesce(F.lead("first").over(over), F.first("first").over(over)).alias("after"))
    return keys.join(F.broadcast(after), "slice").select(*KEY, "n_chars", "copies", F.coalesce(F.lead(at).over(Window.partitionBy("slice").orderBy(*KEY)), F.col("after")).alias("next"))


def _at_most(sorted_values: Column, value: Column, n: int) -> Column:
    """How many of ``n`` ascending values are at most ``value``, by halving."""
    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        right = F.get(sorted_values, middle) <= value
        open_ = span["low"] < span["high"]
        return F.struct(F.when(open_ & right, middle + 1).otherwise(span["low"]).alias("low"), F.when(open_ & ~right, middle).otherwise(span["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(n.bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")), halve, lambda span: span["low"])


def compare_edited(docs: DataFrame, row_id: str = "doc_id", text: str = "text", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and its successor's.

    The edited text has the last quarter of the code points replaced by as many from
    the start of the next row's text. A null text counts as empty. Rows are ordered by
    id (null first) and the text's hash, so of wholly equal rows all but one are followed
    by an equal one. Gives ``id``, ``n_chars``, ``edited_digest`` (SHA-256, binary),
    ``fingerprint``, ``edited`` and ``following`` (signed longs).

    Texts move once, by key, and the starts that their predecessors ask for; the order
    is found from keys alone.
    """
    slim, texts = _named(docs, row_id, text)
    ordered = durable(in_order(slim, slice_rows))
    # What a text is followed by: an equal one for all copies but one, and its successor.
    itself, successor = F.struct(F.struct(*KEY).alias("next"), (F.col("copies") - 1).alias("times")), F.struct(F.col("next").alias("next"), F.lit(1).cast("long").alias("times"))
    follows = F.filter(F.array(itself, successor), lambda f: f["times"] > 0)
    quarter = lambda n: F.floor(n / 4).cast("int")
    asked = ordered.select(F.struct(*KEY).alias("of"), quarter(F.col("n_chars")).alias("quarter"), F.explode(follows).alias("f")).select("of", "quarter", "f.next.*", "f.times")
    starts = texts.join(asked, list(KEY)).select("of.*", F.struct(*KEY).alias("next"), "times", F.left("text", F.col("quarter")).alias("start"))
    n = F.char_length("text")
    both = texts.join(starts, list(KEY)).select(*KEY, "next", "times", n.cast("long").alias("n_chars"), "text", F.concat(F.left("text", n - quarter(n)), F.col("start")).alias("edited"))
    side = lambda which, body: F.struct(F.lit(which).alias("which"), body.alias("body"))
    each = both.withColumn("edited_digest", F.unhex(F.sha2("edited", 256))).select(*KEY, "next", "times", "n_chars", "edited_digest", F.explode(F.array(side(0, F.col("text")), side(1, F.col("edited")))).alias("v"))
    row = [*KEY, "next", "times", "n_chars", "edited_digest"]
    voted = _votes(each.select(*row, "v.*"), [*row, "which"], "body")
    print_of = lambda which: F.max(F.when(F.col("which") == which, F.col("fingerprint")))
    found = durable(voted.groupBy(*row).agg(print_of(0).alias("fingerprint"), print_of(1).alias("edited")))
    own = found.select(F.struct(*KEY).alias("next"), F.col("fingerprint").alias("following")).distinct()
    compared = found.join(own, "next")
    return each_copy(compared, "times").select(F.when(F.col("named"), F.col("key_id")).alias("id"), "n_chars", "edited_digest", "fingerprint", "edited", "following")


def digits(value: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts.

    ``n_near`` counts the other documents within the radius, for every document whose
    id is divisible by 100; it is null for the rest.
    """
    compared = durable(compare_edited(read(spark, sf_dir, "documents")))
    asks = F.coalesce(F.col("id") % 100 == 0, F.lit(False))
    asked = compared.where(asks)
    near = within_radius(asked, compared).groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    near = durable(near.join(asked.groupBy(F.col("fingerprint").alias("query")).agg(F.count(F.lit(1)).alias("n")), "query").withColumnRenamed("query", "fingerprint"))
    counted = attach(asked, near, ["fingerprint"], asked.count())
    every = counted.unionByName(compared.where(~asks).withColumn("n_near", F.lit(None).cast("long")))
    return every.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.lower(F.hex("edited_digest")).alias("edited_sha256"),
        digits(F.col("fingerprint")).alias("fingerprint"),
        digits(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
        "n_near",
    )

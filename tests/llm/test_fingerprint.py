"""Native fingerprints, edited texts and block tables against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest
from xxhash import xxh64_intdigest

from tallyforge.llm import fingerprint as P
from tests.llm import corpus as small

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(text):
    words, ones, total = text.encode().translate(LOWER).split(), [0] * 64, 0
    for i in range(len(words)):
        term = b" ".join(words[i : i + 2])
        weight, hashed = min(15, len(term)), xxh64_intdigest(term, 42)
        total += weight
        for bit in range(64):
            ones[bit] += weight * (hashed >> bit & 1)
    return sum((2 * n > total) << bit for bit, n in enumerate(ones))


def texts(seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["Ab", "çd", "efg", "h", "ijklmnopqrstuvw"]) + str(rng.randrange(9)) for _ in range(rng.choice([0, 1, 2, 9, 60, 5000]))) for _ in range(24)]


def test_fingerprints_equal_brute_force(spark):
    rows = list(enumerate(texts(1))) + [(90, None), (91, ""), (92, "\t \n"), (93, "p q"), (93, "p q"), (93, "r"), (None, "r")]
    got = [(r["id"], r["fingerprint"] % 2**64) for r in P.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(map(str, got)) == sorted(str((i, brute(t or ""))) for i, t in rows)


@pytest.mark.parametrize("slice_rows", [1, P.SLICE_ROWS])
def test_edited_texts_and_successors(spark, slice_rows):
    rows = [(i * 7 - 50, t, "x") for i, t in enumerate(texts(2))] + [(1000, None, "x")]
    got = {r["id"]: r for r in P.compare_edited(spark.createDataFrame(rows, "doc_id bigint, text string, at string"), slice_rows=slice_rows).collect()}
    assert len(got) == len(rows)
    for (i, t, _), (_, after, _) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        n = len(t)
        edited = t[: n - n // 4] + after[: n // 4]
        r = got[i]
        assert r["n_chars"] == n and bytes(r["edited_digest"]) == hashlib.sha256(edited.encode()).digest()
        assert [r[c] % 2**64 for c in ("fingerprint", "edited", "following")] == [brute(t), brute(edited), brute(after)]


def test_ties_nulls_and_empty_tables(spark):
    schema = "doc_id bigint, text string"
    rows = [(None, "b b b b"), (None, "a a a a"), (3, "c c c c"), (3, "c c c c"), (5, "d d d d")]
    got = P.compare_edited(spark.createDataFrame(rows, schema)).collect()
    order = [*sorted(("a a a a", "b b b b"), key=lambda t: xxh64_intdigest(t, 42) ^ 2**63), "c c c c", "c c c c", "d d d d"]
    assert sorted((r["fingerprint"] % 2**64, r["following"] % 2**64) for r in got) == sorted((brute(a), brute(b)) for a, b in zip(order, order[1:] + order[:1]))
    assert P.compare_edited(spark.createDataFrame([], schema)).count() == 0
    alone = P.compare_edited(spark.createDataFrame([(1, "x y z w")], schema)).collect()
    assert len(alone) == 1 and alone[0]["fingerprint"] == alone[0]["following"]


@pytest.mark.parametrize(("radius", "blocks"), [(3, 5), (2, 4), (0, 1)])
def test_block_tables_find_all(spark, radius, blocks):
    rng = random.Random(radius)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in values[:20]:
        values += [v ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 5)))]
    signed = [v - 2**64 if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    found = {(r["query"], r["fingerprint"]): r["n"] for r in P.within_radius(frame.limit(25), frame, radius, blocks).collect()}
    asked = {r["fingerprint"] for r in frame.limit(25).collect()}
    want = {(a, b): signed.count(b) for a in asked for b in set(signed) if (a % 2**64 ^ b % 2**64).bit_count() <= radius}
    assert found == want


def test_registered_query(spark, tmp_path):
    docs = small.texts()
    rows = {r["doc_id"]: r for r in P.op7_fingerprint(spark, small.written(spark, tmp_path, docs)).collect()}
    order = sorted(docs)
    prints = {i: brute(docs[i] or "") for i in order}
    alike = lambda a, b: 1 - (a ^ b).bit_count() / 64
    assert rows.keys() == docs.keys()
    for i, after in zip(order, order[1:] + order[:1]):
        t, r = docs[i] or "", rows[i]
        edited = t[: len(t) - len(t) // 4] + (docs[after] or "")[: len(t) // 4]
        own = brute(edited)
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[i]:016x}", f"{own:016x}")
        assert (r["near_edited"], r["near_next"]) == (alike(prints[i], own), alike(prints[i], prints[after]))
        near = sum((prints[i] ^ p).bit_count() <= P.RADIUS for p in prints.values()) - 1
        assert r["n_near"] == (near if i % 100 == 0 else None)

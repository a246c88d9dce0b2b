"""Near duplicates by shingle similarity, against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline as C
from tallyforge.llm import jaccard as J
from tallyforge.llm.simhash import fingerprint, shingles, words


def similar(a, b):
    """Whether two texts are of similarity 0.8 or more, from the shingles themselves."""
    x, y = (set(shingles(words(t), 5)) for t in (a, b))
    return 5 * len(x & y) >= 4 * len(x | y)


def brute(texts):
    """The smallest id that each id reaches over similar pairs; ``texts`` by id."""
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and similar(texts[a], texts[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in texts}


def found(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    return {r["id"]: r["component"] for r in J.near_duplicates(docs).collect()}


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, text, kind, share):
    n = int(len(text) * share)
    at = rng.randrange(len(text) - n)
    if kind == "appended":
        return text + prose(rng, n)
    if kind == "cut":
        return text[: len(text) - n]
    if kind == "block":
        return text[:at] + prose(rng, n) + text[at + n :]
    out = list(text)
    for i in rng.sample(range(len(text)), n):
        out[i] = f"x{i}"
    return out


def kept(spark, texts):
    rows = [(i, t, "k") for i, t in texts.items()]
    return {r["doc_id"] for r in C.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string, key string"), "").collect()}


def test_pairs_at_least_as_similar_meet_whatever_the_edit(spark):
    rng, texts = random.Random(3), {}
    for i in range(0, 480, 2):
        base = prose(rng, rng.randint(60, 600))
        kind, most = [("appended", 0.2), ("cut", 0.17), ("block", 0.08), ("scattered", 0.02)][i // 2 % 4]
        texts |= {i: " ".join(base), i + 1: " ".join(edited(rng, base, kind, most * rng.uniform(0.8, 1)))}
    near = {i + 1 for i in range(0, 480, 2) if similar(texts[i], texts[i + 1])}
    assert len(near) > 180 and kept(spark, texts) == set(texts) - near


def test_buckets_follow_the_similarity():
    rng = random.Random(4)
    for n, low, high in ((55, 0.34, 0.48), (166, 0.03, 0.10)):  # of similarity 0.8 and 0.5
        pairs = [(t, t[n:] + prose(rng, n)) for t in (prose(rng, 500) for _ in range(60))]
        met = [(J.bands(J.shingle_set(" ".join(x))) == J.bands(J.shingle_set(" ".join(y)))).mean() for x, y in pairs]
        assert low < sum(met) / len(met) < high


def test_odd_texts(spark):
    texts = {0: "a b c d e f", 1: "A b c\td e  f", 2: "a b c", 3: "a b c", 4: "c b a", 5: None, 6: "", 7: " \n ", 8: "a b c d"}
    assert found(spark, texts) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8}
    rows = spark.createDataFrame([(1, "p q r s t"), (1, "p q r s t u"), (None, "p q r s t"), (None, "lone")], "doc_id bigint, text string")
    assert sorted(((r["id"], r["component"]) for r in J.near_duplicates(rows).collect()), key=str) == sorted([(1, 1), (1, 1), (None, 1), (None, None)], key=str)
    assert J.near_duplicates(rows.where("false")).count() == 0


def test_pairs_less_similar_stay(spark):
    rng, texts = random.Random(7), {}
    for i in range(0, 160, 2):
        base = prose(rng, rng.randint(100, 500))
        texts |= {i: " ".join(base), i + 1: " ".join(edited(rng, base, "scattered", rng.uniform(0.025, 0.05)))}
    apart = {i + 1 for i in range(0, 160, 2) if not similar(texts[i], texts[i + 1])}
    assert len(apart) > 60 and kept(spark, texts) == set(range(0, 160, 2)) | apart


def test_families_of_a_template_and_chains(spark):
    rng, texts = random.Random(9), {}
    template = prose(rng, 300)
    for i in range(30):  # any two share about 0.75 of their shingles
        texts[i] = " ".join(template + prose(rng, 48))
    step = prose(rng, 400)
    for i in range(30, 50):  # neighbours are similar, the ends are not
        texts[i] = " ".join(step)
        step = step[20:] + prose(rng, 20)
    order = list(texts)
    rng.shuffle(order)
    texts = {i: texts[j] for i, j in enumerate(order)}
    expected = brute(texts)
    assert len(set(expected.values())) == 31 and found(spark, texts) == expected


def test_fingerprints_within_few_bits_miss_pairs_that_bands_find():
    """Why the stage does not take its candidates from covering masks on 64-bit fingerprints."""
    rng, found = random.Random(1), []
    while len(found) < 300:
        base = prose(rng, rng.randint(100, 600))
        kind, most = rng.choice([("appended", 0.2), ("cut", 0.2), ("scattered", 0.025)])
        other = edited(rng, base, kind, rng.uniform(0, most))
        x, y = (set(shingles([w.encode() for w in t], 5)) for t in (base, other))
        similarity = len(x & y) / len(x | y)
        if 0.8 <= similarity < 1:
            differ = (fingerprint(shingles([w.encode() for w in base], 5)) ^ fingerprint(shingles([w.encode() for w in other], 5))).bit_count()
            met = (J.bands(J.shingle_set(" ".join(base))) == J.bands(J.shingle_set(" ".join(other)))).any()
            found.append((similarity, differ, met))
    low = [differ for similarity, differ, _ in found if similarity < 0.85]
    assert len(low) > 30 and sum(d <= 3 for d in low) < 0.1 * len(low) and 7 < sum(low) / len(low) < 11
    assert all(met for *_, met in found)


def test_covering_tables_meet_all_pairs_within_the_radius():
    rng = random.Random(12)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3)))
        # One hash is its own majority.
        assert (J.tables(J.np.array([x], J.np.uint64)) == J.tables(J.np.array([y], J.np.uint64))).any()


def test_family_members_with_too_much_of_their_own_are_not_listed_as_pairs(spark):
    rng = random.Random(13)
    template = prose(rng, 300)
    texts = [" ".join(template + prose(rng, 48)) for _ in range(60)]  # similarity about 0.75
    texts += [texts[0] + " one more end", texts[1] + " another end"]
    sets = [J.shingle_set(t) for t in texts]
    frame = spark.createDataFrame([(J.node_of(s), s.view("int64").tolist()) for s in sets], "node bigint, hashes array<bigint>")
    nodes = frame.selectExpr("node", "size(hashes) as size", "node as component")
    pairs = {(r["a"], r["b"]) for r in J._apart(J._prefixes(nodes, frame)).collect()}
    similar_pairs = {tuple(sorted((J.node_of(sets[i]), J.node_of(sets[j])))) for i in range(62) for j in range(i) if similar(texts[i], texts[j])}
    assert len(similar_pairs) == 2 and pairs == similar_pairs

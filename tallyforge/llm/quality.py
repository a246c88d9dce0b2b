"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation
maximisation over the counts of all vote patterns in the corpus estimates how often
each labeller votes either way on good and on bad texts, and with that the posterior
of each pattern. The posteriors are the labels on which a linear scorer over hashed
text features is trained; the scorer then judges every text.

Only two things reach the driver: one count for each vote pattern that occurs (at
most 3 ** labellers), and the hashed features of a bounded sample of texts.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOOD, BAD, NONE = 1, 0, 2
DIMENSIONS = 1024
#: Slots of hashed words and word pairs, and how much a text's vector of them weighs beside its shares and ratios.
TERM_DIMENSIONS, TERM_WEIGHT = 512, 3.0
#: Texts whose hashed features and posteriors train the scorer, at most; the driver holds 6 kB for each, twice.
TRAINING_TEXTS = 4_000
EM_ROUNDS = 200
DESCENT_ROUNDS = 400
THRESHOLD = 0.5
#: Columns whose spread is taken at a time.
COLUMNS_AT_ONCE = 256
#: Texts that a worker holds parsed.
TEXTS_AT_ONCE = 128

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it was on with as by an at from or are be this not but he his they she "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es "
    "le la les de et des est un une que en pour dans qui au il elle par sur "
    "el los las del y se por con una su para como más o no al lo".encode().split()
)

#: Classes of bytes: space, lower, upper, digit, sentence mark, other ASCII, beyond ASCII.
CLASSES = np.full(256, 5, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = 0
CLASSES[97:123] = 1
CLASSES[65:91] = 2
CLASSES[48:58] = 3
CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = 4
CLASSES[128:] = 6
N_CLASSES = 7
SENTENCE_ENDS = np.isin(np.arange(256), [ord(c) for c in ".?!"])


@dataclass(frozen=True)
class Text:
    """Counts of a text that labellers and features share."""

    words: list[bytes]
    octets: np.ndarray
    by_class: np.ndarray
    first: np.ndarray
    last: np.ndarray
    lengths: np.ndarray
    repeated: float
    run: int
    top: float
    distinct: float
    function: float
    packed: float

    @staticmethod
    def of(text: str) -> Text:
        raw = text.encode()
        octets = np.frombuffer(raw, np.uint8)
        words = raw.split()
        n = max(1, len(words))
        space = CLASSES[octets] == 0
        begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        ends = np.flatnonzero(~space & np.concatenate((space[1:], [True])))
        lowered = [w.lower() for w in words]
        counts = Counter(words)
        breaks = np.flatnonzero(~np.fromiter(map(operator.eq, words, words[1:]), bool, max(0, len(words) - 1)))
        runs = np.diff(np.concatenate(([-1], breaks, [len(words) - 1])))
        return Text(
            words,
            octets,
            np.bincount(CLASSES[octets], minlength=N_CLASSES),
            octets[begins],
            octets[ends],
            ends - begins + 1,
            (len(words) - 1 - len(breaks)) / n if words else 0.0,
            int(runs.max()),
            max(counts.values(), default=0) / n,
            len(counts) / n,
            sum(map(FUNCTION_WORDS.__contains__, lowered)) / n,
            len(zlib.compress(raw, 1)) / max(1, len(raw)),
        )


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


def _symbols(t: Text) -> int:
    share = t.by_class[5] / max(1, len(t.octets) - t.by_class[0])
    return _vote(share > 0.10, share < 0.02)


def _capitals(t: Text) -> int:
    letters = t.by_class[1] + t.by_class[2]
    share = t.by_class[2] / max(1, letters)
    return _vote(letters >= 20 and share > 0.5, letters >= 20 and share < 0.2)


def _repeats(t: Text) -> int:
    return _vote(len(t.words) >= 6 and t.repeated > 0.2, len(t.words) >= 6 and t.repeated < 0.05)


def _longest_run(t: Text) -> int:
    return _vote(t.run >= 6, len(t.words) >= 20 and t.run <= 3)


def _packing(t: Text) -> int:
    """How far the text can be compressed; short texts hardly can."""
    return _vote(len(t.octets) >= 200 and t.packed < 0.25, len(t.octets) >= 200 and t.packed > 0.33)


def _top_word(t: Text) -> int:
    return _vote(len(t.words) >= 15 and t.top > 0.25, len(t.words) >= 15 and t.top < 0.15)


def _exclaims(t: Text) -> int:
    """Words that end in an exclamation mark."""
    share = float((t.last == 33).mean()) if len(t.words) else 0.0
    return _vote(len(t.words) >= 4 and share > 0.3, len(t.words) >= 4 and share < 0.1)


def _variety(t: Text) -> int:
    n = len(t.words)
    return _vote(n >= 30 and t.distinct < 0.1, n >= 30 and t.distinct > 0.25)


def _prose(t: Text) -> int:
    return _vote(len(t.words) >= 12 and t.function < 0.03, len(t.words) >= 12 and t.function > 0.12)


def _word_ends(t: Text) -> int:
    """Words that end in something other than a letter, digit or sentence mark."""
    share = float(np.isin(CLASSES[t.last], (5,)).mean()) if len(t.words) else 0.0
    return _vote(len(t.words) >= 4 and share > 0.25, len(t.words) >= 4 and share < 0.05)


def _bars(t: Text) -> int:
    alone = float(((t.lengths == 1) & (CLASSES[t.first] == 5)).mean()) if len(t.words) else 0.0
    return _vote(len(t.words) >= 8 and alone > 0.2, len(t.words) >= 8 and alone < 0.05)


def _sentences(t: Text) -> int:
    """Words for each sentence end."""
    ends = int(SENTENCE_ENDS[t.last].sum()) if len(t.words) else 0
    per = len(t.words) / max(1, ends)
    return _vote(len(t.words) >= 20 and (per > 60 or per < 1.5), len(t.words) >= 20 and 3 <= per <= 40)


LABELLERS = (_symbols, _capitals, _repeats, _longest_run, _packing, _top_word, _variety, _prose, _word_ends, _bars, _exclaims, _sentences)


def _slots(kind: str, n: int) -> np.ndarray:
    return np.array([zlib.crc32(f"{kind}:{i}".encode()) % DIMENSIONS for i in range(n)])


SLOTS = np.concatenate((_slots("first", 256), _slots("last", 256), _slots("length", 32), _slots("turn", N_CLASSES**2), _slots("ratio", 11)))

#: Words by which a short text's features count half: it says little about its kind.
HALF_WORDS = 12


def terms(t: Text) -> np.ndarray:
    """Words (A-Z lower-cased) and pairs of neighbours, hashed into slots: damped counts of unit length."""
    lowered = [w.lower() for w in t.words]
    one = list(map(zlib.crc32, lowered))
    both = np.array(one + list(map(zlib.crc32, lowered[1:], one)), np.int64) % TERM_DIMENSIONS
    counts = np.log1p(np.bincount(both, minlength=TERM_DIMENSIONS))
    return counts / max(1e-9, float(np.sqrt((counts**2).sum())))


def hashed(t: Text) -> np.ndarray:
    """The hashed feature vector of a text: shares of first and last bytes of words, word lengths
    and byte-class pairs, and ratios, summed into ``DIMENSIONS`` slots; then its ``terms``."""
    n, classes = max(1, len(t.words)), CLASSES[t.octets].astype(np.int64)
    pairs = np.bincount(classes[:-1] * N_CLASSES + classes[1:], minlength=N_CLASSES**2) if len(classes) > 1 else np.zeros(N_CLASSES**2)
    letters = max(1, t.by_class[1] + t.by_class[2])
    ratios = [t.repeated, min(1.0, t.run / 10), t.top, t.packed, t.distinct, t.function, t.by_class[2] / letters, t.by_class[5] / max(1, len(t.octets)), min(1.0, n / 100), float(SENTENCE_ENDS[t.last].sum()) / n, 1.0]
    values = np.concatenate((np.bincount(t.first, minlength=256) / n, np.bincount(t.last, minlength=256) / n, np.bincount(np.minimum(t.lengths, 31), minlength=32) / n, pairs / max(1, len(classes)), ratios))
    assert len(values) == len(SLOTS)
    return np.concatenate((np.bincount(SLOTS, weights=values, minlength=DIMENSIONS), terms(t)))


def sureness(t: Text) -> float:
    return len(t.words) / (len(t.words) + HALF_WORDS)


def vote_pattern(t: Text) -> int:
    """All labellers' votes as one number, a base-3 digit each."""
    return sum(f(t) * 3**i for i, f in enumerate(LABELLERS))


def votes_of(patterns: np.ndarray) -> np.ndarray:
    """A row of votes for each pattern."""
    return np.stack([patterns // 3**i % 3 for i in range(len(LABELLERS))], axis=1)


@dataclass(frozen=True)
class LabelModel:
    """The share of good texts, and for bad and good texts the chance of each labeller's votes.

    An abstention says nothing, so it counts neither way.
    """

    prior: float
    chances: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes = votes_of(patterns)
        voted = [np.where(votes[:, i] == NONE, 0.0, np.log(self.chances[:, i, np.minimum(votes[:, i], 1)])) for i in range(len(LABELLERS))]
        logs = np.log([1 - self.prior, self.prior])[:, None] + sum(voted)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation maximisation from majority votes; every chance is smoothed by one count."""
    votes = votes_of(patterns)
    good = ((votes == GOOD).sum(axis=1) + 0.5) / ((votes != NONE).sum(axis=1) + 1.0)
    good = np.where((votes == BAD).sum(axis=1) >= 2, np.minimum(good, 0.2), good)
    model = None
    for _ in range(rounds):
        weight = np.stack((1 - good, good)) * counts
        chances = np.stack([[[(weight[c] * (votes[:, i] == v)).sum() + 1 for v in (BAD, GOOD)] for i in range(len(LABELLERS))] for c in range(2)])
        chances = chances / chances.sum(axis=2, keepdims=True)
        prior = float(np.clip((weight[1].sum() + 1) / (weight.sum() + 2), 1e-6, 1 - 1e-6))
        model = LabelModel(prior, chances)
        before, good = good, model.posterior(patterns)
        if np.abs(good - before).max() < 1e-9:
            break
    return model


@dataclass(frozen=True)
class Scorer:
    """A logistic scorer over hashed features: shares and ratios standardised, terms by one weight."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray, sure: np.ndarray) -> np.ndarray:
        z = sure * (((features - self.mean) / self.scale).clip(-8, 8) @ self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _spread(features: np.ndarray) -> np.ndarray:
    """Standard deviations of the columns, some at a time."""
    return np.concatenate([features[:, i : i + COLUMNS_AT_ONCE].std(axis=0, dtype=np.float64) for i in range(0, features.shape[1], COLUMNS_AT_ONCE)])


def fit_scorer(features: np.ndarray, sure: np.ndarray, target: np.ndarray, rounds: int = DESCENT_ROUNDS, ridge: float = 1e-3) -> Scorer:
    """Gradient descent on the cross-entropy with soft targets."""
    mean, scale = features.mean(axis=0, dtype=np.float64), _spread(features)
    scale = np.where(scale < 1e-9, np.inf, scale)
    scale[DIMENSIONS:] = 1 / TERM_WEIGHT
    # One copy, of the features' own width, changed in place.
    x = np.subtract(features, mean.astype(features.dtype))
    x /= scale.astype(features.dtype)
    np.clip(x, -8, 8, out=x)
    x *= sure[:, None].astype(features.dtype)
    weights, bias, step = np.zeros(x.shape[1]), 0.0, 0.5 / max(1.0, float(np.einsum("ij,ij->i", x, x).mean()) / 4)
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ weights.astype(x.dtype) + bias, -60, 60))) - target
        weights -= step * (error.astype(x.dtype) @ x / len(x) + ridge * weights)
        bias -= step * error.mean()
    return Scorer(mean, scale, weights, float(bias))


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def _patterns(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns of all texts and how many have each."""
    schema = pa.schema([pa.field("pattern", pa.int32()), pa.field("n", pa.int64())])

    def run(batches):
        for batch in batches:
            found = np.array([vote_pattern(Text.of(v.as_py())) for v in batch.column("text")], np.int64)
            values, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32)), pa.array(n)], schema=schema)

    rows = _texts(docs, text).mapInArrow(run, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    return np.array([r.pattern for r in rows], np.int64), np.array([r.n for r in rows], np.float64)


def _sample(docs: DataFrame, text: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns and hashed features of at most ``most`` texts, those with the smallest hashes."""
    schema = pa.schema([pa.field("pattern", pa.int32()), pa.field("features", pa.binary())])

    def run(batches):
        for part in (batch.slice(i, TEXTS_AT_ONCE) for batch in batches for i in range(0, batch.num_rows, TEXTS_AT_ONCE)):
            texts = [Text.of(v.as_py()) for v in part.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([vote_pattern(t) for t in texts], pa.int32()), pa.array([np.append(hashed(t), sureness(t)).astype(np.float32).tobytes() for t in texts], pa.binary())], schema=schema)

    # Distinct texts are chosen by hash, then read; only hashes are sorted.
    hashes = _texts(docs, text).select(F.xxhash64("text").alias("h"))
    last = hashes.distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return np.zeros(0, np.int64), np.zeros((0, DIMENSIONS + TERM_DIMENSIONS + 1))
    chosen = _texts(docs, text).withColumn("h", F.xxhash64("text")).where(F.col("h") <= last).dropDuplicates(["h"])
    rows = chosen.select("text").mapInArrow(run, "pattern int, features binary").collect()  # at most ``most`` rows
    rows = sorted((r.pattern, bytes(r.features)) for r in rows)
    return np.array([r[0] for r in rows], np.int64), np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(len(rows), DIMENSIONS + TERM_DIMENSIONS + 1)


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    scorer: Scorer

    def score(self, texts: list[str]) -> tuple[list[float], list[float]]:
        """Weak posterior and score of texts; a text without words scores 0."""
        parsed = [Text.of(t) for t in texts]
        if not parsed:
            return [], []
        posterior = self.labels.posterior(np.array([vote_pattern(t) for t in parsed], np.int64))
        score = self.scorer.score(np.stack([hashed(t) for t in parsed]), np.array([sureness(t) for t in parsed]))
        return posterior.tolist(), [float(s) if t.words else 0.0 for s, t in zip(score, parsed)]


def fit(docs: DataFrame, text: str = "text", training_texts: int = TRAINING_TEXTS) -> QualityModel | None:
    """A model of this corpus: label model over all texts, scorer on at most ``training_texts``. None for an empty table.

    A null text counts as an empty one, on which every labeller abstains; repeated texts
    count as often in the label model and once in the scorer's sample.
    """
    patterns, counts = _patterns(docs, text)
    if not len(patterns):
        return None
    labels = fit_labels(patterns, counts)
    sample, features = _sample(docs, text, training_texts)
    return QualityModel(labels, fit_scorer(features[:, :-1], features[:, -1], labels.posterior(sample)))


def score(docs: DataFrame, model: QualityModel | None, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``weak_posterior`` and ``score`` (0 to 1, good is high) for each row; other columns are not read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(f"`{row_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    wanted = rows.select("id", F.lit(0.0).alias("weak_posterior"), F.lit(0.0).alias("score")).schema
    schema = to_arrow_schema(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                posterior, scores = shared.value.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id").cast(schema.field("id").type), pa.array(posterior, pa.float64()), pa.array(scores, pa.float64())], schema=schema)

    return rows.mapInArrow(run, wanted)


def keep_good(docs: DataFrame, model: QualityModel | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, columns unchanged; nothing is shuffled.

    Null, empty and wordless texts are rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                texts = [t or "" for t in part.column(text).to_pylist()]
                _, scores = shared.value.score(texts)
                yield part.filter(pa.array([s >= threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document by the model of all documents."""
    from tallyforge.llm.tables import read

    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs))
    return scored.select(F.col("id").alias("doc_id"), F.round("weak_posterior", 6).alias("weak_posterior"), F.round("score", 6).alias("score"), (F.col("score") >= THRESHOLD).alias("keep"))

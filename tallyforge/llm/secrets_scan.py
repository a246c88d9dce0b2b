"""Secret scanning with a random forest that removes false positives, in DataFrame functions alone.

Candidates are long runs of key-like characters in whole texts, and whatever is assigned
to a name with a secret word. A forest trained on labelled findings judges each by its
length, its character transitions, how much of it a dictionary covers, its path and its
neighbouring words. The dictionary is the whole words of a tokenizer's vocabulary. The
trained trees are written out as one SQL expression, so texts are scanned once, judged and
redacted in one projection, without Python workers and without moving a text.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.tables import durable, each_copy, read

#: Runs of 16 key-like characters or more; a sign "=" ends one unless only "=" follow, so ``NAME=`` is not in its value.
CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}+(?:=++(?![A-Za-z0-9+/_\-]))?+|(?=[A-Za-z0-9+/=_\-]{16})[A-Za-z0-9+/_\-]*+=++(?![A-Za-z0-9+/_\-])"
BEFORE_CHARS, AFTER_CHARS = 48, 16
TREES, DEPTH, SEED = 15, 6, 11
#: Labelled findings that a forest is trained on at most, and that are made by default.
MAX_LABELLED = 20_000
MADE_LABELLED = 6_000
#: Dictionary words, at most, that made findings are built of.
MADE_WORDS = 500
REDACTED = "[SECRET]"

#: The vocabulary whose whole words are the dictionary, and its letters at least.
VOCABULARY, WORD_LETTERS = "byte_bpe_multi_50k.tiktoken", 4
#: Marks the ends of findings while a text is cut; a text that holds it is cut in another way.
MARK = "\x01"

# Words that stand before secrets, and words that stand before other long strings.
SECRET_WORDS = "token|secret|passw|pwd|api.?key|apikey|access.?key|private.?key|auth|bearer|credential|client.?secret"
OTHER_WORDS = "commit|sha1|sha256|md5|checksum|digest|hash|uuid|guid|etag|revision|build|version|card|iban|isbn|phone|order|example|base64,|placeholder"
#: What is assigned to a name with a secret word: up to the closing quote, or else to a space or quote, whatever its length.
ASSIGNED = (
    r"(?<=[=:]\s?[\"'`]?)" rf"(?<=(?i:{SECRET_WORDS})[\w\-]{{0,16}}[\"'`]?\s{{0,2}}:?[=:]\s?[\"'`]?)"
    r"(?:(?<=[\"'`])[^\r\n\"'`]++(?=[\"'`])|[^\s\"'`=:](?:[^\s\"'`]*[^\s\"'`.,;:)\]}>])?)"
)
#: All that is judged (a Java expression).
SCANNED = f"{ASSIGNED}|{CANDIDATE}"
PLAIN_PATHS = "test|example|fixture|mock|doc|sample|lock"
PLAIN_VALUES = "^x+$|your|insert|replace|change.?me|example|goes.?here|placeholder|redacted|dummy|^none$|^null$|^todo$"

FEATURES = (
    "length", "transitions", "vowel_turns", "distinct", "entropy", "digits", "upper", "hex", "symbols", "odd_symbols", "brackets",
    "dictionary", "slashes", "plain_path", "secret_word", "other_word", "said_plain", "assigned", "quoted", "repeats",
)


@lru_cache
def dictionary(path: str | None = None) -> tuple[str, ...]:
    """The words of ``WORD_LETTERS`` lower-case letters or more that a vocabulary of ranked tokens has, by rank.

    The driver reads the file; its size bounds them.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines if line.strip()))
    return tuple(dict.fromkeys(t[1:].decode() for _, t in ranked if re.fullmatch(rb" [a-z]{%d,}" % WORD_LETTERS, t)))


def _share(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern)) / F.greatest(F.length(x), F.lit(1))


def _known(x: Column, words: tuple[str, ...]) -> Column:
    """The characters of ``x`` in runs of letters (cut where a capital starts a word) that are dictionary words."""
    by_letter = F.array(*[F.lit(" ".join(["", *(w for w in words if w[0] == chr(c)), ""])) for c in range(97, 123)])
    runs = F.transform(F.regexp_extract_all(x, F.lit(rf"([A-Z]?[a-z]{{{WORD_LETTERS - 1},}}|[A-Z]{{{WORD_LETTERS},}}(?![a-z]))"), F.lit(1)), F.lower)
    known = F.filter(runs, lambda w: F.contains(F.element_at(by_letter, F.ascii(w) - 96), F.concat(F.lit(" "), w, F.lit(" "))))
    return F.aggregate(known, F.lit(0), lambda n, w: n + F.length(w))


def features(x: Column, before: Column, after: Column, path: Column, words: tuple[str, ...] | None = None) -> Column:
    """A struct of doubles, named by ``FEATURES``; no argument may be null."""
    low, n = F.lower(x), F.greatest(F.length(x), F.lit(1))
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    turns = F.regexp_replace(F.regexp_replace(low, "[aeiouy]+", "0"), "[a-z]+", "1")
    characters = F.array_distinct(F.split(x, ""))
    share = lambda c: (F.length(x) - F.length(F.replace(x, c, F.lit("")))) / n
    entropy = F.aggregate(F.transform(F.filter(characters, lambda c: c != ""), lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, b: a + b)
    near = F.lower(F.right(before, F.lit(24)))
    yes = lambda c: c.cast("double")
    values = {
        "length": F.least(n, F.lit(400)),
        "transitions": F.length(runs) / n,
        "vowel_turns": F.length(turns) / n,
        "distinct": F.size(characters) / n,
        "entropy": entropy,
        "digits": _share(x, "[0-9]"),
        "upper": _share(x, "[A-Z]"),
        "hex": _share(x, "[0-9a-fA-F]"),
        "symbols": _share(x, "[^A-Za-z0-9]"),
        "odd_symbols": _share(x, r"[^A-Za-z0-9+/=_\-]"),
        "brackets": _share(x, r"[(){}\[\]<>$]"),
        "dictionary": _known(x, words or dictionary()) / n,
        "slashes": _share(x, "/"),
        "plain_path": yes(F.lower(path).rlike(PLAIN_PATHS)),
        "secret_word": yes(near.rlike(SECRET_WORDS)),
        "other_word": yes(near.rlike(OTHER_WORDS)),
        "said_plain": yes(low.rlike(PLAIN_VALUES)),
        "assigned": yes(F.rtrim(F.regexp_replace(before, "[\"'`]$", "")).rlike("[=:]$")),
        "quoted": yes(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "repeats": 1 - F.length(F.regexp_replace(x, r"(.)\1+", "$1")) / n,
    }
    return F.struct(*[values[name].cast("double").alias(name) for name in FEATURES])


def made_findings(spark: SparkSession, rows: int = MADE_LABELLED, words: tuple[str, ...] | None = None) -> DataFrame:
    """Labelled findings from rules, the same at every call: ``id``, ``kind``, ``finding``, ``before``, ``after``, ``path``, ``label``.

    Secrets are random strings in the usual alphabets after a telling word; the others
    are names, words, numbers, digests, identifiers, paths, rulers, calls and placeholders.
    """
    words = words or dictionary()
    known = F.split(F.lit(" ".join(words[:: -(-len(words) // MADE_WORDS)])), " ")

    def make(ident: Column) -> Column:
        def pick(salt: int, *options: str) -> Column:
            return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(ident, F.lit(salt)), F.lit(len(options))) + 1).cast("int"))

        word = lambda salt: F.element_at(known, (F.pmod(F.xxhash64(ident, F.lit(f"w{salt}")), F.size(known)) + 1).cast("int"))
        random_hex = lambda salt: F.sha2(F.concat(ident.cast("string"), F.lit(f"/{salt}")), 256)
        random_64 = F.regexp_replace(F.base64(F.unhex(F.concat(random_hex(1), random_hex(9)))), "=", "")
        plain_64 = F.regexp_replace(random_64, "[+/]", "")
        number = F.conv(F.substring(random_hex(2), 1, 13), 16, 10)
        uuid = F.regexp_replace(F.substring(random_hex(3), 1, 32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        quote = pick(4, '"', "'", "", "`")
        say = pick(5, "token", "api_key", "API-KEY", "secret", "password", "passwd", "access_key", "auth", "client_secret", "TOKEN", "Secret", "db_password", "private_key", "apikey")
        link = pick(6, " = ", "=", ": ", ":", " := ")
        prose = F.concat(word(1), F.lit(" "), word(2), pick(9, " ", ". ", ", ", " | ", "\n", "; "))
        assigned = F.concat(prose, say, link, quote)
        length = pick(10, "20", "24", "32", "40", "48", "64").cast("int")
        short = pick(34, "8", "9", "10", "12", "14").cast("int")
        mark = pick(32, "!", ".", "@", "$", "#", "%", "&", "-", "_")
        snake, camel = F.concat_ws("_", word(3), word(4), word(5)), F.concat(word(3), F.initcap(word(4)), F.initcap(word(5)))
        no = F.lit(" ")
        kinds = [
            ("hex", 1, F.substring(random_hex(1), F.lit(1), length), assigned, quote),
            ("upper hex", 1, F.upper(F.substring(random_hex(1), F.lit(1), length)), F.concat(F.upper(prose), F.upper(say), link, quote), quote),
            ("base64", 1, F.substring(random_64, F.lit(1), length), assigned, quote),
            ("letters and digits", 1, F.substring(plain_64, F.lit(1), length), assigned, quote),
            ("prefixed", 1, F.concat(pick(11, "ghp_", "sk-", "AKIA", "xoxb-", "glpat-", "AIza", "npm_"), F.substring(plain_64, F.lit(1), F.least(length, F.lit(36)))), F.concat(prose, pick(12, "", "Bearer ", "token ", "key ", "use ", "-H ")), no),
            ("header", 1, F.concat(F.lit("eyJ"), F.substring(plain_64, F.lit(1), length)), F.concat(prose, pick(35, "Bearer ", "jwt ", "Authorization: ", "token=")), F.lit(".")),
            ("password", 1, F.concat(F.substring(plain_64, F.lit(1), F.lit(3)), mark, F.substring(plain_64, F.lit(5), short - 3)), assigned, quote),
            ("short", 1, F.substring(plain_64, F.lit(1), short), assigned, quote),
            ("word and digits", 1, F.concat(pick(36, "", "X"), F.initcap(word(3)), F.substring(number, 1, 3), mark, F.substring(plain_64, F.lit(1), F.lit(2))), assigned, quote),
            ("name", 0, snake, prose, pick(13, " ", ".", ",", "\n", "(")),
            ("camel name", 0, camel, prose, pick(13, " ", ".", ",", "(")),
            ("constant", 0, F.upper(snake), F.upper(prose), F.lit(" ")),
            ("words", 0, F.concat_ws("-", word(3), word(4), word(5), word(6)), prose, pick(13, " ", ".", ",")),
            ("run of letters", 0, F.concat(*[F.substring(word(20 + i), 1, 3) for i in range(7)]), prose, pick(13, " ", ".", ",")),
            ("number", 0, F.concat(number, F.substring(number, 1, 4)), F.concat(prose, pick(15, "", "card ", "order: ", "phone = ", "iban ", "id=")), no),
            ("digest", 0, F.substring(random_hex(1), F.lit(1), pick(16, "32", "40", "64").cast("int")), F.concat(prose, pick(17, "commit ", "sha256:", "md5 = ", "checksum: ", 'etag: "', "revision ", "digest=")), pick(13, " ", '"')),
            ("encoded digest", 0, F.concat(F.substring(random_64, 1, 43), F.lit("=")), F.concat(prose, pick(37, "sha256-", 'integrity="sha256-', "digest: ", "sha512-")), pick(13, '"', " ")),
            ("uuid", 0, uuid, F.concat(prose, pick(18, "uuid: ", "guid=", "id ", "")), no),
            ("path", 0, F.concat(F.lit("/"), word(3), F.lit("/"), word(4), F.lit("/"), snake), F.concat(prose, pick(19, "https://", "file: ", "path = ", "import ")), F.lit(".")),
            ("ruler", 0, F.repeat(pick(3, "-", "=", "_", "x", "0", "A", "*"), length), F.concat(prose, pick(30, "", "\n", "token = ")), F.lit("\n")),
            ("placeholder", 0, pick(31, "your-api-key-here", "INSERT_TOKEN_HERE", "replace-with-your-secret", "changeme-changeme", "my_secret_password_value", "example_token_goes_here", "changeme", "xxxxxxxx", "none", "null", "<password>", "todo", "********", "<your token>", "redacted"), assigned, quote),
            ("name assigned", 0, F.when(ident % 2 == 0, snake).otherwise(camel), F.concat(prose, say, link), F.lit("\n")),
            ("call assigned", 0, F.concat(pick(38, "get_", "load_", "read", "config.", "self.", "os.environ[", "${", "{{ "), snake, pick(39, "()", "(name)", "", "]", "}", " }}")), F.concat(prose, say, link), F.lit("\n")),
            ("word assigned", 0, word(3), assigned, quote),
            ("type assigned", 0, pick(40, "string", "str", "String", "required", "optional", "true", "false", "basic", "oauth2", "bearer", "Option<String>"), F.concat(prose, say, pick(41, ": ", " = ", "=")), pick(42, "\n", ",", ";")),
        ]
        path = pick(43, "app/settings.py", "src/main.go", "deploy/prod.env", "lib/client.js", "web", "tests/test_login.py", "examples/demo.yaml", "docs/setup.md", "yarn.lock", "crawl", "")
        chosen = None
        for i, (kind, label, finding, before, after) in enumerate(kinds):
            row = F.struct(F.lit(kind).alias("kind"), F.lit(label).cast("double").alias("label"), finding.alias("finding"), F.right(before, F.lit(BEFORE_CHARS)).alias("before"), after.alias("after"), path.alias("path"))
            here = F.when(ident % len(kinds) == i, row)
            chosen = here if chosen is None else F.coalesce(chosen, here)
        return chosen

    # Within a lambda, because generated code would be too large.
    made = F.element_at(F.transform(F.array("id"), make), 1)
    whole = spark.range(0, rows, 1, 2).select("id", made.alias("made")).select("id", "made.kind", "made.label", "made.path", F.concat("made.before", "made.finding", "made.after").alias("text"))
    # Cut as a text is scanned: the finding is the last that the scan takes.
    cut = whole.select("id", "kind", "label", "path", F.regexp_extract_all("text", F.lit(SCANNED), F.lit(0)).alias("found"), F.split("text", SCANNED, -1).alias("pieces"))
    before, after = F.right(F.element_at("pieces", -2), F.lit(BEFORE_CHARS)), F.left(F.element_at("pieces", -1), F.lit(AFTER_CHARS))
    return cut.where(F.size("found") > 0).select("id", "kind", "label", F.element_at("found", -1).alias("finding"), before.alias("before"), after.alias("after"), "path")


def vectors(labelled: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``label`` and ``features`` of the labelled findings that a forest is trained on."""
    from pyspark.ml.feature import VectorAssembler

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = durable(labelled.where(F.col("label").isNotNull()).orderBy(F.xxhash64("finding", "before", "after", "path")).limit(most))
    # Within a lambda, as when texts are scanned: too large an expression for generated code.
    one = F.array(F.struct(*[text(c).alias(c) for c in ("finding", "before", "after", "path")]))
    f = F.element_at(F.transform(one, lambda c: features(c["finding"], c["before"], c["after"], c["path"])), 1)
    table = durable(rows.select(f.alias("f"), F.col("label").cast("double").alias("label")).select("label", "f.*"))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)


def fit(table: DataFrame, trees: int = TREES, depth: int = DEPTH):
    """The forest as Spark's model; ``table`` has ``label`` and ``features``."""
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird").fit(table)


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, most: int = MAX_LABELLED) -> str:
    """A forest on labelled findings, as its public text form.

    At most ``most`` findings are used, those with the smallest hashes; ``labelled`` has
    ``finding``, ``before``, ``after``, ``path`` and ``label`` (1: a secret). Null strings
    read as empty, rows without a label are left out and repeated rows count as often.
    Without a finding that is a secret the form is empty, and nothing is called a secret.
    """
    table = vectors(labelled, most)
    return "" if table.where("label = 1").isEmpty() else fit(table, trees, depth).toDebugString


def forest_score(forest: str, f: Column) -> Column:
    """The share of trees that call a finding a secret; ``f`` is a struct of features."""
    trees, lines = [], [(len(line) - len(line.lstrip()), line.strip()) for line in forest.splitlines() if line.strip()]
    at = 0

    def node() -> Column:
        nonlocal at
        line = lines[at][1]
        at += 1
        if leaf := re.fullmatch(r"Predict: ([\d.]+)", line):
            return F.lit(float(leaf[1]))
        test = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        left = node()
        at += 1  # the line "Else (feature ...)"
        right = node()
        return F.when(f[FEATURES[int(test[1])]] <= float(test[2]), left).otherwise(right)

    while at < len(lines):
        if lines[at][1].startswith("Tree "):
            at += 1
            trees.append(node())
        else:
            at += 1
    if not trees:
        return F.lit(0.0)
    total = trees[0]
    for tree in trees[1:]:
        total = total + tree
    return total / len(trees)


def _scanned(docs: DataFrame, text: str, path: str | None) -> DataFrame:
    """``docs`` as a struct ``row``, with ``path``, ``pieces`` of text round the candidates and ``candidates``."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    where = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path and path in docs.columns else F.lit("")
    # Marked once, then cut at the marks: findings are every other part. In a projection of its own, so it runs once.
    once = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        where.alias("path"),
        F.when(~F.contains(body, F.lit(MARK)), F.split(F.regexp_replace(body, SCANNED, f"{MARK}$0{MARK}"), MARK, -1)).alias("parts"),
    )
    body = F.coalesce(F.col("row").getField(text).cast("string"), F.lit(""))
    every = lambda first: F.filter("parts", lambda _, i: i % 2 == first)
    cut = once.select(
        "row", "path",
        F.coalesce(every(1), F.regexp_extract_all(body, F.lit(SCANNED), F.lit(0))).alias("found"),
        F.coalesce(every(0), F.split(body, SCANNED, -1)).alias("pieces"),
    )
    return cut.select(
        "row", "path", "pieces",
        F.zip_with(
            F.zip_with("found", F.slice("pieces", F.lit(1), F.size("found")), lambda x, p: F.struct(x.alias("x"), F.right(p, F.lit(BEFORE_CHARS)).alias("before"), F.length(p).alias("gap"))),
            F.slice("pieces", F.lit(2), F.size("found")),
            lambda c, p: F.struct(c["x"].alias("x"), c["before"].alias("before"), c["gap"].alias("gap"), F.left(p, F.lit(AFTER_CHARS)).alias("after")),
        ).alias("candidates"),
    )


def scan(docs: DataFrame, forest: str, row_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """Every candidate: ``id``, ``nth``, ``start`` and ``length`` in code points, ``finding`` and ``score``.

    A score of 0.5 or more is a secret. Null and empty texts have no candidate; repeated
    rows give their findings as often; other columns are not read, and without a column of
    that name the path is empty.
    """
    slim = docs.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), (F.col(f"`{path}`") if path and path in docs.columns else F.lit("")).cast("string").alias("path"))
    # Outer, because a filter for texts without candidates would be pushed down and scan them again.
    named = _scanned(slim, "text", "path").select(F.col("row.id").alias("id"), F.xxhash64("row.text").alias("key"), "path", "candidates")
    each = named.select("id", "key", "path", F.posexplode_outer("candidates").alias("nth", "c")).where(F.col("c").isNotNull())
    # Within a lambda, as too large an expression for generated code.
    score = F.element_at(F.transform(F.array(features(F.col("c.x"), F.col("c.before"), F.col("c.after"), F.col("path"))), lambda f: forest_score(forest, f)), 1)
    found = each.select("id", "key", "nth", "c.x", "c.gap", score.alias("score")).groupBy("id", "key", "nth", "x", "gap").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("times"))
    so_far = Window.partitionBy("id", "key").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("gap").cast("long") + F.length("x")).over(so_far) - F.length("x")
    placed = found.select("id", "nth", start.alias("start"), F.length("x").alias("length"), F.col("x").alias("finding"), "score", "times")
    return each_copy(placed, "times")


def redact(docs: DataFrame, forest: str, text: str = "text", path: str | None = "source", threshold: float = 0.5, n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with each secret in its text replaced by ``REDACTED``; columns and rows stay.

    A column ``n_chars`` is counted anew for the texts that change. Null texts stay null.
    """
    hit = F.exists("judged", lambda c: c["score"] >= threshold)
    said = F.transform("judged", lambda c: F.when(c["score"] >= threshold, F.lit(REDACTED)).otherwise(c["x"]))
    parts = F.flatten(F.zip_with("pieces", said, lambda piece, x: F.array(piece, F.coalesce(x, F.lit("")))))
    # Two projections, so that features are taken once.
    featured = _scanned(docs, text, path).select("row", "path", "pieces", F.transform("candidates", lambda c: F.struct(c["x"].alias("x"), features(c["x"], c["before"], c["after"], F.col("path")).alias("f"))).alias("candidates"))
    judged = featured.select("row", "pieces", F.transform("candidates", lambda c: F.struct(c["x"].alias("x"), forest_score(forest, c["f"]).alias("score"))).alias("judged"))
    rebuilt = judged.select("row", F.when(hit, F.array_join(parts, "")).alias("clean"))
    columns = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == text:
            old = F.coalesce(F.col("clean"), old)
        elif c == n_chars:
            old = F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    return rebuilt.select(*columns)


_FORESTS: dict[int, str] = {}


def default_forest(spark: SparkSession) -> str:
    """The forest of the made findings, trained once in a process; it is the same at every training."""
    if MADE_LABELLED not in _FORESTS:
        _FORESTS[MADE_LABELLED] = train(made_findings(spark))
    return _FORESTS[MADE_LABELLED]


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents with their verdicts; findings are given by digest."""
    found = scan(read(spark, sf_dir, "documents"), default_forest(spark))
    return found.select(F.col("id").alias("doc_id"), "nth", "start", "length", F.sha2("finding", 256).alias("finding_sha256"), "score", (F.col("score") >= 0.5).alias("is_secret"))

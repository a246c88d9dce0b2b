"""URL verdicts from pattern rules that are indexed by their rarest literal token.

A pattern rule is a line of a filter list. Its literal tokens are the runs of letters
and digits, of three or more, that every matching URL must hold whole: those with a
separator or an anchor on both sides. Rules are indexed by the one of their tokens that
the fewest rules share; a URL's own tokens fetch the rules to try, and only those run
their regular expression. Rules without such a token are tried on every URL. Host and
path rules for domains are looked up by the host's suffixes in the same way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.tables import attach, durable, read

#: More rules than this are joined by shuffle; below it, they are broadcast.
BROADCAST_RULES = 50_000

TOKEN = r"[a-z0-9]{3,}"
#: What stands for the parts of a line in its regular expression; as Java and RE2 have it, not Python.
HOST_START, ANYTHING, SEPARATOR, END = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*\.)?", "(?s:.*)", r"(?:[^a-z0-9_.%\-]|\z)", r"\z"


@dataclass(frozen=True)
class PatternRule:
    """A line of a filter list, on the lower-cased URL.

    ``||`` stands for the start of the host or of a domain of it, ``|`` for either end of the
    URL, ``*`` for anything, ``^`` for a separator or the end; ``@@`` in front allows.
    """

    line: str

    def __post_init__(self):
        body = self.line.removeprefix("@@")
        if not body.strip("|*^") or "$" in body or "##" in body or "#@#" in body or body.startswith("!") or re.fullmatch(r"/.*/", body) and len(body) > 1 and re.search(r"[\\\[\](){}+]", body):
            raise ValueError(f"not a line that is supported: {self.line}")
        if "|" in body.removeprefix("||").removeprefix("|").removesuffix("|"):
            raise ValueError(f"an anchor within the line: {self.line}")

    @property
    def verdict(self) -> str:
        return "allow" if self.line.startswith("@@") else "block"

    @property
    def parts(self) -> list[str]:
        """Anchors, ``*``, ``^`` and single characters in their order."""
        body = self.line.removeprefix("@@").translate(_LOWER)
        front = next(p for p in ("||", "|", "") if body.startswith(p))
        end = "|" if body.endswith("|") else ""
        return [p for p in (front, *body[len(front) : len(body) - len(end)], end and "|end") if p]

    @property
    def pattern(self) -> str:
        said = {"||": HOST_START, "|": "^", "*": ANYTHING, "^": SEPARATOR, "|end": END}
        return "".join(said[p] if p in said else p if p.isalnum() and p.isascii() else f"\\{p}" if p.isascii() else p for p in self.parts)

    @property
    def tokens(self) -> tuple[str, ...]:
        """What every match holds as whole tokens of the URL."""
        parts, found, run = ["*", *self.parts, "*"], [], ""
        before = "*"
        for part in parts:
            if len(part) == 1 and re.fullmatch("[a-z0-9]", part):
                run += part
                continue
            if run and before != "*" and part != "*" and re.fullmatch(TOKEN, run):
                found.append(run)
            run, before = "", part
        return tuple(dict.fromkeys(found))


_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class DomainRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The domain rules asked for.
DOMAIN_RULES = (
    DomainRule("net", "/", "block"),
    DomainRule("example.net", "/en/", "allow"),
    DomainRule("example.com", "/de/", "block"),
    DomainRule("org", "/fr/", "allow"),
)

PATTERN_RULES = tuple(map(PatternRule, (
    "||spam-farm.", "||casino.", "||casino-", "||betting.", "||betting-", "||porn.", "||porn-", "-porn.", "/login^", "/wp-admin^",
    ".exe?", ".exe|", "?affid=", "&affid=", "@@||spam-farm.*/help/",
)))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return ascii_lower(host), path


def index_rules(rules: Sequence[PatternRule]) -> list[tuple[str, str, str, int]]:
    """(token, pattern, verdict, number) with each rule under its rarest token among the rules, or else under none."""
    share = Counter(t for r in rules for t in r.tokens)
    rarest = lambda r: min(r.tokens, key=lambda t: (share[t], -len(t), t), default="")
    return [(rarest(r), r.pattern, r.verdict, number) for number, r in enumerate(rules)]


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_RULES else df


def judge(pages: DataFrame, row_id: str = "page_id", url: str = "url", domain_rules: Sequence[DomainRule] = DOMAIN_RULES, pattern_rules: Sequence[PatternRule] = PATTERN_RULES, default: str = "allow") -> DataFrame:
    """One row per page: ``id``, ``host``, ``path``, ``rule``, ``verdict``, ``pattern``.

    The longest fitting domain rule decides; else a matching allow pattern, else a
    matching block pattern, else ``default``. A null URL and one without ``://`` have
    an empty host and path and fit no rule. Repeated ids stay apart; empty tables give
    no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    base = base.select("id", "url", host.alias("host"), path.alias("path"))
    # The verdict depends on the URL alone, so each distinct URL is judged once.
    urls = base.where(F.col("url").isNotNull()).groupBy("url", "host", "path").agg(F.count(F.lit(1)).alias("n"))

    domains = spark.createDataFrame([(r.host, r.path, r.name, r.verdict) for r in domain_rules], "suffix string, prefix string, rule string, says string")
    # A suffix starts at the host or after one of its dots.
    suffix = F.explode(F.array_distinct(F.concat(F.array("host"), F.regexp_extract_all("host", F.lit(r"(?<=\.)(?=([^/?#]*))"), F.lit(1))))).alias("suffix")
    named = (
        urls.select("url", "path", suffix)
        .join(_sized(domains, len(domain_rules)), "suffix")
        .where(F.expr("startswith(path, prefix)"))
        .groupBy("url")
        .agg(F.max_by(F.struct("rule", "says"), F.struct(F.length("rule"), "rule")).alias("named"))
    )

    rules = index_rules(pattern_rules)
    indexed = spark.createDataFrame(rules, "token string, pattern string, says string, number int")
    lowered = ascii_lower(F.col("url"))
    tokens = F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"({TOKEN})")))
    if any(not token for token, *_ in rules):
        tokens = F.array_append(tokens, F.lit(""))
    matched = (
        urls.select("url", lowered.alias("lowered"), F.explode(tokens).alias("token"))
        .join(_sized(indexed, len(rules)), "token")
        .where(F.expr("lowered rlike pattern"))
        .groupBy("url")
        # allow goes before block, then the earlier rule
        .agg(F.min(F.struct(F.col("says"), F.col("number"), F.col("pattern"))).alias("matched"))
    )
    judged = urls.select("url", "n").join(named, "url", "left").join(matched, "url", "left").where(F.col("named").isNotNull() | F.col("matched").isNotNull())
    says = durable(judged.select("url", F.col("named.rule").alias("rule"), F.coalesce("named.says", "matched.says").alias("says"), F.when(F.col("named").isNull(), F.col("matched.pattern")).alias("pattern"), "n"))
    columns = ["id", "host", "path", "rule", F.coalesce("says", F.lit(default)).alias("verdict"), "pattern"]
    known = attach(base.where(F.col("url").isNotNull()), says, ["url"], base.count(), "left")
    nulls = base.where(F.col("url").isNull()).select("*", *[F.lit(None).cast("string").alias(c) for c in ("rule", "says", "pattern")])
    return known.select(*columns).unionByName(nulls.select(*columns))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict under the default rules."""
    return judge(read(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _oracle() -> str:
    lowered = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def any_of(says: str) -> str:
        return " OR ".join(f"regexp_matches({lowered}, '{r.pattern}')" for r in PATTERN_RULES if r.verdict == says)

    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.name}', '{r.verdict}')" for r in DOMAIN_RULES)
    return f"""
WITH rules(suffix, prefix, rule, says) AS (VALUES {rules}),
u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, url,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (
  SELECT h.*, (SELECT struct_pack(rule := r.rule, says := r.says) FROM rules r
    WHERE (h.host = r.suffix OR ends_with(h.host, '.' || r.suffix)) AND starts_with(h.path, r.prefix)
    ORDER BY length(r.rule) DESC, r.rule DESC LIMIT 1) AS named FROM h)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, named.rule AS rule,
  coalesce(named.says, CASE WHEN {any_of("allow")} THEN 'allow' WHEN {any_of("block")} THEN 'block' ELSE 'allow' END) AS verdict
FROM f
"""


OP9_SQL = _oracle()

"""URL verdicts."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from tallyforge.llm import url_filter as U

CASES = [
    ("https://EXAMPLE.net/x", "example.net", "/x", "net/", "block"), ("https://m.example.net/en/1", "m.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.com/de/?a=/x", "example.com", "/de/", "example.com/de/", "block"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("http://a.org/fr/x#y", "a.org", "/fr/x", "org/fr/", "allow"), ("http://x.net", "x.net", "", None, "allow"), ("http://spam-farm.example.org/en/7", "spam-farm.example.org", "/en/7", None, "block"),
    ("http://SPAM-farm.example.org/HELP/7", "spam-farm.example.org", "/HELP/7", None, "allow"), ("http://spam-farm.example.org/fr/7", "spam-farm.example.org", "/fr/7", "org/fr/", "allow"),
    ("http://farm.example.org/a", "farm.example.org", "/a", None, "allow"), ("http://a.com/login", "a.com", "/login", None, "block"), ("http://a.com/my-login-x", "a.com", "/my-login-x", None, "allow"),
    ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("x://", "", "", None, "allow"), ("http://a.com?u=b://c.net/", "a.com", "", None, "allow"),
    ("http://a..net/", "a..net", "/", "net/", "block"), ("http://net/", "net", "/", "net/", "block"),
]


def test_verdicts(spark):
    rows = [(i, c[0], "x") for i, c in enumerate(CASES)]
    pages = spark.createDataFrame(rows + rows[:2] + [(None, CASES[0][0], "x")], "page_id bigint, url string, rule string")
    got = [(r["id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages).collect()]
    want = [(i, *c[1:]) for i, c in enumerate(CASES)]
    assert sorted(map(str, got)) == sorted(map(str, want + want[:2] + [(None, *CASES[0][1:])]))


def test_tokens_are_those_that_every_match_holds_whole():
    tokens = {line: U.PatternRule(line).tokens for line in ("||casino.", "casino.", "/casino", "||a.betting^", "/x*Banner/", "*-ads-*", "|http://ads|", "/ad/", "@@||spam-farm.*/help/", "&utm_source=")}
    assert tokens == {
        "||casino.": ("casino",), "casino.": (), "/casino": (), "||a.betting^": ("betting",), "/x*Banner/": (), "*-ads-*": ("ads",), "|http://ads|": ("http", "ads"),
        "/ad/": (), "@@||spam-farm.*/help/": ("spam", "farm", "help"), "&utm_source=": ("utm", "source"),
    }
    for bad in ("", "!note", "||x$script", "a|b", "example.com##.ad", "/ads[0-9]+/", "^*^"):
        with pytest.raises(ValueError):
            U.PatternRule(bad)


def test_rules_stand_under_their_rarest_token():
    rules = [U.PatternRule(x) for x in ("/common/rare/", "/common/", "/common/odd/", "any*")]
    assert [r[0] for r in U.index_rules(rules)] == ["rare", "common", "odd", ""]


def test_random_rules_equal_all_expressions(spark):
    rng = random.Random(3)
    pick = lambda n: "".join(rng.choice(["ads", "spam", "shop", "a", "x1", ".", "/", "-", "?", "=", "&", "É", "*", "^"]) for _ in range(n))
    rules = []
    while len(rules) < 120:
        try:
            rules.append(U.PatternRule(rng.choice(["", "", "", "", "", "@@"]) + rng.choice(["", "|", "||"]) + pick(rng.randint(1, 5)) + rng.choice(["", "|"])))
        except ValueError:
            continue
    urls = [rng.choice(["http://", "HTTPS://", "x"]) + rng.choice(["ads.", "Spam.", ""]) + pick(rng.randint(1, 9)).replace("*", "y").replace("^", rng.choice("~/\n")) for _ in range(400)]
    python = [re.compile(r.pattern.replace(r"\z", r"\Z")) for r in rules]

    def brute(url):
        fits = [r for r, p in zip(rules, python) if p.search(url.translate(U._LOWER))]
        return "allow" if any(r.verdict == "allow" for r in fits) or not fits else "block"

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r["id"]: r["verdict"] for r in U.judge(pages, domain_rules=(), pattern_rules=rules).collect()}
    want = {i: brute(u) for i, u in enumerate(urls)}
    assert got == want and 10 < sum(v == "block" for v in want.values()) < 395


def test_urls_from_another_column_and_registered_query(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.com/x", "http://b.net/y")], "n bigint, url string, link string")
    assert tuple(U.judge(pages, "n", "link").select("host", "rule").first()) == ("b.net", "net/")
    rows = [(i, c[0], "x") for i, c in enumerate(CASES)] * 2 + [(i, None, "x") for i in range(50)] + [(i, CASES[0][0], "x") for i in range(40)]
    spark.createDataFrame(rows, "page_id bigint, url string, rule string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    theirs = duck.execute(U.OP9_SQL)
    ours = U.op9_url_filter(spark, str(tmp_path)).select(*[c[0] for c in theirs.description]).collect()
    assert sorted(str(tuple(r)) for r in ours) == sorted(map(str, theirs.fetchall()))


def test_long_urls_and_empty_tables(spark):
    long = "http://" + "a." * 2000 + "net/" + "spam/" * 20000
    pages = spark.createDataFrame([(1, long)], "page_id bigint, url string")
    assert U.judge(pages).first()["rule"] == "net/"
    assert U.judge(pages.where("false")).count() == 0

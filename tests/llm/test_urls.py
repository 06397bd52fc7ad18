"""Url rules against their SQL, brute force over all rules, and both ways of matching."""

import random

import pytest
from pyspark.sql import functions as F

from brightwater.llm.urls import BLOCK, RULES, URLS_SQL, Trie, judge, strength, url_filter
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


def brute(rules, host, path):
    fits = [
        (strength(h, p, v), h + p, v)
        for h, p, v in rules
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def test_query_agrees_with_sql(spark):
    assert compare(url_filter(spark, FOLDER), connect(FOLDER), URLS_SQL) == ""


def random_case(seed):
    pick = random.Random(seed)
    label = lambda: pick.choice(["a", "b", "ab", "c", ""])
    host = lambda n: ".".join(label() or "x" for _ in range(pick.randint(1, n)))
    path = lambda: "".join(pick.choice(["/", "/a", "/ab", "/abc", "/b"]) for _ in range(pick.randint(0, 4)))
    rules = [(pick.choice([host(2), host(3), ""]), path(), pick.choice(["allow", "block"])) for _ in range(60)]
    urls = [(i, f"http://{host(4)}{path()}{pick.choice(['', '?q=/a', '#f'])}") for i in range(300)]
    return rules, urls


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("trie_rules", [10**6, 0])
def test_equals_brute_force(spark, seed, trie_rules):
    rules, urls = random_case(seed)
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), trie_rules=trie_rules)
    rows = got.collect()
    assert len(rows) == len(urls)
    for r in rows:
        rule, verdict = brute(rules, r.host, r.path)
        assert (r.rule, r.verdict) == (rule, verdict or "allow"), r


def test_many_tails_at_one_node():
    rules = [("x", f"/p{i}", BLOCK) for i in range(50)]
    assert Trie(rules).find("a.x", "/p49/q") == ("x/p49", BLOCK)
    assert Trie(rules).find("x", "/q") == (None, None)


@pytest.mark.parametrize("trie_rules", [10**6, 0])
def test_odd_rows(spark, trie_rules):
    rows = [
        (1, None), (2, ""), (3, "example.org/es/"), (4, "HTTP://WWW.Example.ORG/es/x"), (5, "http://org"), (None, "x://org/"),
        (6, "a://b://org/"), (7, "http://exampleX.org?/es/"), (8, "http://example.org/en/15#/"), (8, "http://example.org/en/15#/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("r"))
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in judge(pages, rules, trie_rules=trie_rules).collect())
    assert got == sorted([
        ("1", "", "", None, "allow"), ("2", "", "", None, "allow"), ("3", "", "", None, "allow"),
        ("4", "www.example.org", "/es/x", "example.org/es/", "block"), ("5", "org", "", None, "allow"),
        ("None", "org", "/", "org/", "allow"), ("6", "b:", "//org/", None, "allow"),
        ("7", "examplex.org", "", None, "allow"),
        ("8", "example.org", "/en/15", "example.org/en/1", "block"), ("8", "example.org", "/en/15", "example.org/en/1", "block"),
    ])
    assert judge(pages.limit(0), rules, trie_rules=trie_rules).collect() == []
    assert judge(pages, rules.limit(0), trie_rules=trie_rules).where("rule is not null").count() == 0

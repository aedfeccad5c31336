"""URL rules by trie and by join against a plain scan of the rules."""

import random
import re

import pytest

from codelake.llm import url_filters as U

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
         ("block", "a.example.org/"), ("allow", "a.example.org/x/y"), ("block", "a.example.org/x/y"), ("allow", "example.org/en/")]


def plain(url, rules):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = found.groups() if found else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for action, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((h.count("."), len(p), action == "block", rule, action))
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def urls():
    random.seed(2)
    hosts = ["org", "example.org", "a.example.org", "b.a.EXAMPLE.org", "xexample.org", "com", "x.com", "net", "", "example.org:80", "ünï.org"]
    paths = ["", "/", "/es", "/es/", "/en/1", "/en/12/x", "/en/", "/fr/q", "/de/", "/x/y", "/x/yz", "//es/", "/ES/", "/x/y/z?a=://b", "#/es/", "?/de/"]
    made = [f"{s}://{h}{p}" for h in hosts for p in paths for s in ("http", "HTTPS")]
    return [*made, *made[:5], None, "", "no host", "a://b://c/es/", "http://" + "a." * 3000 + "org/" + "p/" * 3000, "http://x.org/line\nbreak"]


@pytest.mark.parametrize("bound", [U.MAX_TRIE_BYTES, 0])
def test_every_url(spark, bound):
    given = urls()
    df = spark.createDataFrame(list(enumerate(given)), "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df, RULES, max_trie_bytes=bound).collect()}
    assert got == {k: plain(u, RULES) for k, u in enumerate(given)}


def test_clashing_columns_other_default_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://q.net/", "old", "old")], "page_id bigint, url string, HOST string, rule string")
    row = U.filter_urls(df, RULES, otherwise="block").collect()[0]
    assert (row.host, row.rule, row.verdict) == ("q.net", None, "block")
    assert U.filter_urls(df.limit(0), RULES).count() == 0
    assert U.filter_urls(df, spark.createDataFrame(RULES, "action string, rule string")).count() == 1


def test_bad_rules_are_refused():
    for rule in [("allow", "nopath"), ("allow", "/x"), ("keep", "org/")]:
        with pytest.raises(ValueError):
            U.UrlTrie([rule])

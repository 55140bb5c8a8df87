from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from labelloom.llm.url_filter import Globs, Rule, filter_urls


def regex(glob: str) -> re.Pattern:
    parts = re.split(r"(\*\*|\*)", glob)
    return re.compile("".join({"**": "(?s:.*)", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts))


globs = st.lists(st.text(alphabet="ab/*.", max_size=70), min_size=1, max_size=6)


@given(globs, st.lists(st.text(alphabet="ab/.é", max_size=80), max_size=6))
def test_all_patterns_at_once(patterns, strings):
    data = [s.encode() for s in strings]
    offsets = np.cumsum([0, *map(len, data)])
    got = Globs(patterns).matches(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert got.tolist() == [[bool(regex(p).fullmatch(s)) for p in patterns] for s in strings]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("b.org/x", "block"), Rule("b.org/y", "allow"))


def test_urls(spark):
    urls = {
        "http://EXAMPLE.net/en/1?q": ("example.net", "/en/1", "example.net/en/", "allow"),
        "http://a.example.net/EN/": ("a.example.net", "/EN/", "net/", "block"),
        "http://example.net": ("example.net", "", None, "allow"),
        "http://evilexample.net/en/": ("evilexample.net", "/en/", "net/", "block"),
        "http://internet/": ("internet", "/", None, "allow"),
        "http://net?x=/": ("net", "", None, "allow"),
        "x://a.com/b.net/": ("a.com", "/b.net/", None, "allow"),
        "http://b.org/xy#z": ("b.org", "/xy", "b.org/x", "block"),
        "http://É.net/é": ("É.net", "/é", "net/", "block"),
        "http:///en": ("", "/en", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://c.net/" + "a" * 100_000: ("c.net", "/" + "a" * 100_000, "net/", "block"),
    }
    rows = [(i, url, "h", "v") for i, url in enumerate(urls)] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, _rank string")
    got = filter_urls(df, RULES).collect()
    assert sorted(map(tuple, got)) == sorted([(i, *want) for i, want in enumerate(urls.values())] * 2, key=lambda r: r[0])


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a/b")], "page_id bigint, url string")
    assert tuple(filter_urls(df, ()).first()) == (1, "a", "/b", None, "allow")
    assert filter_urls(df.where("false"), RULES, default="block").collect() == []


def test_names_are_hosts_and_paths(spark):
    rules = (Rule("example.com", "block"), Rule("Example.ORG/En", "block"))
    urls = ["http://example.community/", "http://a.example.com/x", "http://EXAMPLE.org/En/1", "http://example.org/en"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r.rule for r in filter_urls(df, rules).collect()}
    assert got == {0: None, 1: "example.com", 2: "Example.ORG/En", 3: None}
    for name in ("", "/path", "a.*/", "*.net/"):
        with pytest.raises(ValueError, match="host and path"):
            Rule(name, "block")

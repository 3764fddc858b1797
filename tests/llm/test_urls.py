from __future__ import annotations

import pytest

from hexaloom.llm.urls import Trie, host_and_path, judge_urls


def test_host_and_path():
    assert host_and_path("HTTP://A.Éx.com/P?q") == ("a.Éx.com", "/P")
    assert host_and_path("x://h#f/p") == ("h", "") and host_and_path("x://h?q/p") == ("h", "")
    assert host_and_path("no scheme") == ("", "") and host_and_path(None) == ("", "") and host_and_path("://") == ("", "")
    assert host_and_path("a://b://c/d") == ("b:", "//c/d")


def test_longest_rule_wins():
    t = Trie([("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "com", "/e"), ("block", "x.net", "")])
    assert t.match("a.com", "/q") == ("com/", "allow") and t.match("a.com", "") is None
    assert t.match("a.com", "/english") == ("com/e", "block") and t.match("example.com", "/en/1") == ("example.com/en/", "block")
    assert t.match("b.www.example.com", "/en/") == ("www.example.com/en/", "allow") and t.match("example.com", "/en") == ("com/e", "block")
    assert t.match("x.net", "") == ("x.net", "block") and t.match("ax.net", "/") is None


def test_all_cases(spark):
    urls = [None, "", "http://a.com/", "http://a.com/", "http://A.COM", "x" * 100_000 + "://b.com/"]
    pages = spark.createDataFrame([(i, u, "mine", "theirs") for i, u in enumerate(urls)], "page_id long, url string, Host string, extra string")
    rows = {r.page_id: r for r in judge_urls(pages, [("block", "com", "/")]).collect()}
    assert [rows[i].verdict for i in range(6)] == ["allow", "allow", "block", "block", "allow", "block"]
    assert rows[0].host == "" and rows[2].host == "a.com" and rows[0].extra == "theirs"
    assert judge_urls(pages.limit(0), []).count() == 0
    with pytest.raises(ValueError):
        judge_urls(pages, [("maybe", "com", "/")])

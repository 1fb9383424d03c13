"""Url filters against DuckDB and against a check of every rule on every url."""

import re

import duckdb
import pytest

from tests.conftest import SF01
from tickframe.llm import queries
from tickframe.llm import url_filters as U


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF01}/pages.parquet')")
    want = con.execute(queries.ORACLE["op2_url_filters"]).fetchall()
    got = queries.QUERIES["op2_url_filters"](spark, SF01)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect())) == sorted(want, key=lambda r: r[0])


URLS = ["http://net/", "http://net", "https://A.NET/x", "https://a.net?x.net/", "http://example.net/en/1", "http://x.example.net/en/",
        "http://badexample.net/en/", "http://example.com/de/1", "http://example.com/de", "https://b.org/fr/?q#z", "http://b.org/fra/",
        "http://spam-farm.example.org/", "http://x.io/a.exe", "http://x.io/a.exe?b", "http://x.io/cgi-bin/x", None, "", "no scheme",
        "://net/", "http://user@host.net:80/p", "http://x.io/p://net/", "http://casino.io/\nx", "http://é.NET/É", "http://net/"]
RULES = queries.SITE_RULES + [U.Rule(p, "block") for p in queries.PAGE_PATTERNS] + [
    U.Rule("*ab*", "block", "short"), U.Rule("|x.io/a", "allow", "start"), U.Rule("||host.net:80^", "allow", "port", 2)]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    after = rest[len(raw):]
    fits = [r for r in RULES if (host + after) and re.search(U.regex(r.pattern), host + after)]
    won = max(fits, key=lambda r: (r.tier, len(r.pattern), U.regex(r.pattern)), default=None)
    return (url, host, re.match(r"[^?#]*", after)[0], won and won.name, won.verdict if won else "allow")


@pytest.mark.parametrize("limit", [10_000, 0])
def test_every_rule_on_every_url(spark, limit, monkeypatch):
    monkeypatch.setattr(U, "MAX_BROADCAST_RULES", limit)
    pages = spark.createDataFrame([(u, "x") for u in URLS], "url string, rule string")
    got = U.judge(pages, RULES).select("row.url", "host", "path", "rule", "verdict").collect()
    key = lambda r: tuple((v is None, v or "") for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(brute, URLS), key=key)
    assert U.judge(pages.limit(0), RULES).count() == 0


def test_literals():
    assert U.literals("||net/") == ["net"] and U.literals("||example.com/de/") == ["example", "com", "de"]
    assert U.literals("*ab*") == [] and U.literals(".exe|") == ["exe"] and U.literals("/en") == []

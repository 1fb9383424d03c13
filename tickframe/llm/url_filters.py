"""URL filters: pattern rules indexed by their rarest literal token.

A pattern is matched against the url from its host on (host letters in lower
case): ``*`` stands for any characters, ``^`` for one separator or an end,
a leading ``||`` for the start of the host or of a parent domain, a leading
or trailing ``|`` for an end of the url.  Every pattern becomes a regular
expression and the whole literal tokens that any match must contain.

The tokens of all distinct urls are counted, each rule is filed under its
rarest token (under '' if it has none), and the tokens of a url fetch its
candidate rules; only those run their regular expression.  Everything is
joins, aggregations and SQL functions.

Null urls and urls without ``://`` have empty host and path and fit no rule.
Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many rules the index is broadcast; beyond, it is joined by shuffle.
MAX_BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    pattern: str
    verdict: str
    name: str | None = None
    #: Rules of a higher tier win; within a tier the longest pattern does.
    tier: int = 0


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains and all paths that start with ``path``."""
    return Rule(f"||{host}{path}", verdict, host + path, 1)


def regex(pattern: str) -> str:
    """The pattern as a regular expression for both Java and RE2."""
    body, head, tail = pattern, "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], "$"
    parts = {"*": ".*", "^": r"(?:^|[^A-Za-z0-9]|$)"}
    return "(?s)" + head + "".join(parts.get(c) or (c if c.isalnum() else "\\" + c) for c in body) + tail


def literals(pattern: str) -> list[str]:
    """Tokens that are whole in every match: no letter or digit can touch them."""
    found = []
    body = pattern.strip("|")
    for m in re.finditer(r"[A-Za-z0-9]+", body):
        left = m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and pattern.startswith("|")
        right = m.end() < len(body) and body[m.end()] != "*" or m.end() == len(body) and pattern.endswith("|")
        if left and right:
            found.append(m[0])
    return found


def url_parts(url):
    """(host, path, rest): rest is the url from its host on, host letters in lower case."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    after = F.substr(rest, F.length(raw) + 1)
    return host, F.regexp_extract(after, r"(?s)^[^?#]*", 0), F.concat(host, after)


def index_rules(tokens: DataFrame, rules: list[Rule]) -> DataFrame:
    """(token, pattern fields): each rule under its rarest literal among ``tokens`` (rest, token)."""
    spark = tokens.sparkSession
    rows = [(i, t, regex(r.pattern), r.verdict, r.name, r.tier, len(r.pattern))
            for i, r in enumerate(rules) for t in literals(r.pattern) or [""]]
    filed = spark.createDataFrame(rows, "rule_id int, token string, regex string, verdict string, name string, tier int, size int")
    if len(rules) <= MAX_BROADCAST_RULES:
        filed = F.broadcast(filed)
    seen = (tokens.join(filed.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls")))
    best = F.min_by(F.struct("token", "regex", "verdict", "name", "tier", "size"),
                    F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token"))
    return filed.join(seen, "token", "left").groupBy("rule_id").agg(best.alias("r")).select("r.*")


def judge(pages: DataFrame, rules: list[Rule], *, default: str = "allow") -> DataFrame:
    """(row, host, path, rule, verdict): each input row as a struct; ``rule`` is
    the winning rule's name, null where none with a name fits."""
    host, path, rest = url_parts(F.col("url"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"),
                        path.alias("path"), rest.alias("rest"))
    urls = rows.select("rest").distinct()
    tokens = urls.select("rest", F.explode(F.array_distinct(F.concat(
        F.array(F.lit("")), F.split("rest", "[^A-Za-z0-9]+")))).alias("token"))
    index = index_rules(tokens, rules)
    if len(rules) <= MAX_BROADCAST_RULES:
        index = F.broadcast(index)
    fits = tokens.join(index, "token").filter(F.expr("rest <> '' AND rlike(rest, regex)"))
    won = fits.groupBy("rest").agg(F.max_by(F.struct("name", "verdict"), F.struct("tier", "size", "regex")).alias("won"))
    return (rows.join(won, "rest", "left")
            .select("row", "host", "path", F.col("won.name").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict")))

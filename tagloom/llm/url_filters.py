"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern in the usual filter-list notation: ``||`` anchors at a host
name or any of its subdomains, ``|`` at the start or end of the address, ``*``
stands for anything and ``^`` for one separator or the end. Its literal tokens
are the runs of letters and digits that a matching address must contain as whole
tokens. Every rule is filed under the one of them that is rarest in the
addresses at hand. The tokens of an address fetch candidate rules by an
equi-join, and only candidates run their regular expression. Rules without a
literal token are filed under the empty token, which every address has, so no
rule is ever missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import ascii_lower, whole

ALLOW, BLOCK = "allow", "block"
TOKEN = "[0-9a-z\u0080-\U0010ffff]+"
TOKEN_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class UrlRule:
    """``kind`` groups rules whose longest fitting one is reported together."""

    name: str
    pattern: str
    action: str
    kind: str = "pattern"


def host_rule(action: str, host: str, path: str) -> UrlRule:
    """A rule for a host with its subdomains and a path prefix."""
    return UrlRule(f"{host}{path}", f"||{host}{path}", action, "base")


# The rules that the query has to apply.
BASE_RULES = (
    host_rule(ALLOW, "com", "/"),
    host_rule(BLOCK, "example.com", "/en/"),
    host_rule(ALLOW, "www.example.com", "/en/"),
    host_rule(BLOCK, "net", "/es/"),
    host_rule(BLOCK, "net", "/fr/"),
)
# Addresses that none of the base rules fits are judged by these.
PATTERN_RULES = tuple(
    UrlRule(pattern, pattern, BLOCK)
    for pattern in (
        "||spam-farm.", "||spam.*", "-spam.*", "||cheap-pills.*", "-pills-*.",
        "||casino.*", "-casino.*", "||free-money.*", "||adult.*", "-adult.*",
        "||xxx.*", "||warez.*", "/wp-login.php", "/phishing/", "/malware/",
        "||click-here-now.*", "||lottery-*.", "||payday-loan*.",
    )
)


def rule_tokens(pattern: str) -> list[str]:
    """Tokens that every matching address holds as whole tokens.

    A run that touches a wildcard or an open end may continue in the address
    and is left out.
    """
    found = []
    for run in re.finditer(TOKEN, pattern.lower()):
        before, after = pattern[: run.start()], pattern[run.end():]
        if before and not before.endswith("*") and after and not after.startswith("*"):
            found.append(run.group())
    return sorted(set(found))


def rule_regex(pattern: str) -> str:
    """The pattern as a regular expression over host and the rest of the address."""
    body, start, end = pattern, "", ""
    if body.startswith("||"):
        start, body = r"^(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        start, body = "^", body[1:]
    if body.endswith("|"):
        end, body = "$", body[:-1]
    pieces = {"*": r"[\s\S]*", "^": r"(?:[^0-9A-Za-z_.%-]|$)"}
    return start + "".join(pieces.get(c) or re.escape(c) for c in body) + end


def url_host(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(whole(url), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: str | Column) -> Column:
    return F.regexp_extract(whole(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)


def rule_index(tokens: DataFrame, rules: Iterable[UrlRule]) -> DataFrame:
    """``(token, rule_no, regex)``: every rule under its rarest literal token.

    ``tokens`` holds a row per address and token. Only tokens that occur in some
    rule are counted, so the counts are no more than the rules have tokens.
    """
    spark = tokens.sparkSession
    numbered = list(enumerate(rules))
    rows = [(token, i) for i, rule in numbered for token in rule_tokens(rule.pattern) or [""]]
    literal = spark.createDataFrame(rows, "token string, rule_no int")
    counts = (
        tokens.join(literal.select("token").distinct(), "token", "left_semi")
        .groupBy("token").agg(F.count("*").alias("seen"))
    )
    rarest = (
        literal.join(counts, "token", "left")
        .groupBy("rule_no")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token")).alias("best"))
        .select("rule_no", F.col("best.token").alias("token"))
    )
    regexes = spark.createDataFrame(
        [(i, rule_regex(rule.pattern)) for i, rule in numbered], "rule_no int, regex string"
    )
    return rarest.join(regexes, "rule_no")


def match_rules(urls: DataFrame, rules: Iterable[UrlRule], url: str = "url") -> DataFrame:
    """``(url, rule_no)``: every rule that fits an address, each address once.

    Equal addresses are judged once. An empty, null or scheme-less address has
    the empty target, which only rules that match empty text fit.
    """
    rules = list(rules)
    if not rules:
        return urls.select(whole(url).alias("url"), F.lit(0).alias("rule_no")).where("false")
    addresses = urls.select(whole(url).alias("url")).distinct().select(
        "url", F.concat(url_host("url"), _rest(F.col("url"))).alias("target")
    )
    tokens = addresses.select(
        "url", "target",
        F.explode(F.array_union(
            F.split(F.lower("target"), TOKEN_SPLIT), F.array(F.lit(""))
        )).alias("token"),
    )
    candidates = tokens.join(rule_index(tokens.select("token"), rules), "token")
    return candidates.where(F.regexp_like("target", F.col("regex"))).select("url", "rule_no")


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url: str = "url",
    base: Iterable[UrlRule] = BASE_RULES,
    patterns: Iterable[UrlRule] = PATTERN_RULES,
    default: str = ALLOW,
) -> DataFrame:
    """One row per page: id, host, path, base rule, pattern and verdict.

    The longest fitting base rule decides (ties: the first by name); then the
    longest fitting pattern; then ``default``. Repeated rows stay repeated, other
    columns of ``pages`` are not read.
    """
    rules = [*base, *patterns]
    facts = pages.sparkSession.createDataFrame(
        [(i, r.name, r.action, r.kind, len(r.name)) for i, r in enumerate(rules)],
        "rule_no int, name string, action string, kind string, size int",
    )
    best = F.struct((-F.col("size")).alias("k"), F.col("name"), F.col("action"))
    fitting = (
        match_rules(pages, rules, url).join(facts, "rule_no")
        .groupBy("url")
        .agg(
            F.min(F.when(F.col("kind") == "base", best)).alias("b"),
            F.min(F.when(F.col("kind") != "base", best)).alias("p"),
        )
    )
    own = pages.select(F.col(id_col).alias("page_id"), whole(url).alias("url"))
    return own.join(fitting, "url", "left").select(
        "page_id",
        url_host("url").alias("host"),
        url_path("url").alias("path"),
        F.col("b.name").alias("rule"),
        F.col("p.name").alias("pattern"),
        F.coalesce("b.action", "p.action", F.lit(default)).alias("verdict"),
    )

"""URL filters: pattern rules indexed by their rarest literal token.

A rule names the literal tokens that any matching URL contains. Token counts over all
URLs pick the rarest one as the rule's index entry. A URL's tokens fetch candidate
rules from the index, and only those run their regular expressions.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved, unused

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """pattern: run on host + path; a host has no slash and a path starts with one. tokens: lower-case literals ([a-z0-9]+) of every match.

    Rules with a name (host and path rules) go before patterns; longer names go first."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    name: str | None = None


def host_rule(verdict: str, name: str) -> Rule:
    """example.com/en/: the host, all its subdomains, and paths that start with /en/."""
    host, _, path = name.partition("/")
    literal = lambda s: re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)
    tokens = [t for t in re.split("[^a-z0-9]+", host) if t]
    inner = [t.lower() for t in re.findall(r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", f"/{path}")]
    return Rule(verdict, rf"^(?:[^/]*\.)?{literal(host)}/{literal(path)}", (*tokens, *inner), name)


#: The method's own patterns: hosts that sell, spam or are for adults.
PATTERNS = (
    Rule("block", r"^(?:[^/]*\.)?cheap-pills\.", ("cheap", "pills")),
    Rule("block", r"^(?:[^/]*\.)?spam-farm\.", ("spam", "farm")),
    Rule("block", r"^(?:[^/]*\.)?adult-[a-z0-9]+\.", ("adult",)),
    Rule("block", r"^(?:[^/]*\.)?(?:online-)?casino(?:-[a-z0-9]+)*\.", ("casino",)),
    Rule("block", r"/viagra(?:[/.\-_]|\z)", ("viagra",)),
    Rule("block", r"/cialis(?:[/.\-_]|\z)", ("cialis",)),
    Rule("block", r"/wp-login\.php\z", ("wp", "login", "php")),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def words(c: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(c), "[^a-z0-9]+"))


def deciding(subjects: DataFrame, rules: DataFrame) -> DataFrame:
    """For each subject that a rule of the table matches, the rule that decides. subjects: distinct rows (subject)."""
    if not rules.where("coalesce(size(tokens), 0) <= 0 or exists(tokens, t -> t is null) or verdict is null or pattern is null or place is null").isEmpty():
        raise ValueError("every rule needs a verdict, a pattern, a place and literal tokens")
    rules = rules.select("verdict", "pattern", "tokens", "name", "place").distinct()
    found = subjects.select("subject", F.explode(words(F.col("subject"))).alias("token"))
    asked = rules.select("*", F.explode("tokens").alias("token"))
    counts = found.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"]
    index = saved(asked.join(counts, "token", "left").groupBy(*rules.columns).agg(rarest.alias("token")))
    hits = found.join(index, "token").where(F.rlike(F.col("subject"), F.col("pattern")))
    rank = F.struct(F.col("name").isNotNull(), F.coalesce(F.length("name"), F.lit(0)), -F.col("place"), "name", "verdict")
    return hits.groupBy("subject").agg(F.max(rank).alias("best")).select("subject", "best.name", "best.verdict")


def filter_by_table(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """url_filter for a table of any number of rules: columns verdict, pattern, tokens, name and place.

    place is a rule's number in the list. The same columns and verdicts as url_filter; a rule
    without tokens, pattern, verdict or place is an error, repeated rules are one, an empty table
    allows all. Patterns are Java regular expressions.

    Plan: distinct URLs are saved; their tokens are counted with map-side combine, for tokens
    that rules name only; rules are joined to URLs by their rarest token, so no literal, and no
    broadcast but by Spark's own size check. URLs that repeat are judged once."""
    subject, name, verdict = (unused(c, pages.columns) for c in ("subject", "own name", "own verdict"))
    host, path = url_parts(F.col(url_col))
    out = pages.withColumn(subject, F.concat(host, path))
    found = deciding(saved(out.select(F.col(subject).alias("subject")).distinct()), rules).toDF(subject, name, verdict)
    out = out.withColumns({"host": host, "path": path}).join(found, subject, "left")
    out = out.withColumns({"rule": F.col(f"`{name}`"), "verdict": F.coalesce(F.col(f"`{verdict}`"), F.lit(default))})
    return out.drop(subject, name, verdict)


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = PATTERNS, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (the name of the deciding host rule, or null) and verdict to every row.

    Of the matching rules the longest name wins, then the first in the list; without a
    match the verdict is default. Null and malformed URLs match no rule; line breaks are
    characters like others; repeated rows and null ids are judged like any. Columns called
    host, path, rule or verdict are replaced.

    Narrow: the index is a literal of one row per rule, in as many hash cells as rules, so
    a token meets about one entry; nothing is shuffled and nothing grows with the pages. One
    aggregate before counts the rules' tokens. For lists of many thousand rules there is
    filter_by_table."""
    if any(not r.tokens for r in rules):
        raise ValueError("every rule needs a literal token")
    subject, own = unused("subject", pages.columns), unused("tokens", pages.columns)
    host, path = url_parts(F.col(url_col))
    rows = pages.withColumn(subject, F.concat(host, path))
    known = sorted({t for r in rules for t in r.tokens})
    tokens = rows.select(F.explode(words(F.col(subject))).alias("token"))
    counts = {r["token"]: r["count"] for r in tokens.where(F.col("token").isin(known)).groupBy("token").count().collect()}
    cells: list[list] = [[] for _ in range(max(1, len(rules)))]
    for k, r in enumerate(rules):
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
        entry = {"named": r.name is not None, "size": len(r.name or ""), "place": -k, "name": r.name, "verdict": r.verdict, "token": token, "pattern": r.pattern}
        cells[zlib.crc32(token.encode()) % len(cells)].append(entry)
    kind = "array<array<struct<named:boolean,size:int,place:int,name:string,verdict:string,token:string,pattern:string>>>"
    index = F.from_json(F.lit(json.dumps(cells)), kind)
    cell = lambda t: F.get(index, F.crc32(t.cast("binary")) % len(cells))
    candidates = F.flatten(F.transform(F.col(own), lambda t: F.filter(cell(t), lambda c: c["token"] == t)))
    hit = F.array_max(F.filter(candidates, lambda c: F.rlike(F.col(subject), c["pattern"])))
    out = pages.withColumns({"host": host, "path": path, subject: F.concat(host, path)})
    out = out.withColumn(own, words(F.col(subject)))
    out = out.withColumn(own, hit)
    return out.withColumns({"rule": F.col(own)["name"], "verdict": F.coalesce(F.col(own)["verdict"], F.lit(default))}).drop(subject, own)

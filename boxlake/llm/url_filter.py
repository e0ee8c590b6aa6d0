"""URL filters: rules indexed by their rarest literal token, with built-in functions only.

A URL is cut into tokens (runs of a-z and 0-9 of the lower-cased host and path). Every rule names literal
tokens that any URL it fits must hold; it is filed under the one that fewest URLs hold. The tokens of a URL
fetch their rules by a join, and only those rules run their pattern on it.

Null URLs and URLs without ``://`` have empty host and path; no rule fits them and they are allowed.
Distinct (host, path) pairs are judged once, so repeated rows cost nothing and all get the same verdict;
null ids pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import LOWER, UPPER, let, small_table


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` runs on host followed by path. A prefix rule (``rank`` its length) beats any pattern rule (0)."""

    name: str
    action: str
    pattern: str
    literals: tuple[str, ...]
    rank: int = 0


def tokens_of(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def prefix_rule(action: str, rule: str) -> UrlRule:
    """``host/path``: fits the host and its subdomains where the path starts with the rule's path."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    whole = path if not path or not re.match("[a-z0-9]", path[-1].lower()) else re.sub("[A-Za-z0-9]+$", "", path)
    return UrlRule(rule, action, rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}",
                   tuple(dict.fromkeys(tokens_of(host) + tokens_of(whole))), len(rule))


def host_word(action: str, word: str) -> UrlRule:
    """A word standing alone between dots or hyphens of the host."""
    return UrlRule(f"word:{word}", action, rf"^[^/]*(?<![^.\-/]){re.escape(word)}(?![^.\-/:])", (word,))


def host_pair(action: str, first: str, second: str) -> UrlRule:
    """Two words next to each other in one host label."""
    return UrlRule(f"pair:{first}-{second}", action,
                   rf"^[^/]*(?<![^.\-/]){re.escape(first)}[-_]?{re.escape(second)}(?![^.\-/:])", (first, second))


BASE_RULES = (prefix_rule("block", "net/"), prefix_rule("allow", "example.net/en/"),
              prefix_rule("block", "example.com/de/"), prefix_rule("allow", "org/fr/"))
BLOCK_WORDS = ("adult porn xxx sex casino casinos poker slots roulette bets betting gambling jackpot pills viagra "
               "pharmacy spam warez torrent crack keygen malware phishing escort payday adserver doubleclick").split()
BLOCK_PAIRS = (("ads", "track"), ("ad", "server"), ("click", "bait"), ("link", "farm"), ("free", "money"),
               ("cheap", "meds"), ("fake", "news"))
METHOD_RULES = tuple(host_word("block", w) for w in BLOCK_WORDS) + tuple(host_pair("block", *p) for p in BLOCK_PAIRS)
RULES = BASE_RULES + METHOD_RULES


def host_path(url: Column) -> Column:
    """Struct (host, path); the host's A-Z are lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return let(F.coalesce(rest, F.lit("")), lambda r: let(
        F.regexp_extract(r, "^[^/?#]*", 0), lambda h: F.struct(
            F.translate(h, UPPER, LOWER).alias("host"),
            F.regexp_extract(F.substring(r, F.length(h) + 1, F.length(r)), "^[^?#]*", 0).alias("path"))))


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.translate(F.concat(host, F.lit("/"), path), UPPER, LOWER), "[^a-z0-9]+"))


def rule_index(urls: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    """One row per rule under its rarest literal. The counts collected are one per literal of the rules; the
    index has a known size, so Spark sends it to the executors while it is small."""
    spark, names = urls.sparkSession, sorted({t for r in rules for t in r.literals})
    seen = dict(urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
                .where(F.col("token").isin(names)).groupBy("token").count().collect()) if names else {}
    return small_table(
        spark, token=[min(r.literals, key=lambda t: (seen.get(t, 0), t)) for r in rules], rule=[r.name for r in rules],
        action=[r.action for r in rules], pattern=[r.pattern for r in rules], rank=[r.rank for r in rules])


def judge(pages: DataFrame, url: str = "url", rules: Sequence[UrlRule] = RULES) -> DataFrame:
    """Add host, path, rule (the longest prefix rule that fits, else null), reason (the rule that decided,
    else null) and verdict (allow unless a rule blocks). Columns of those names are replaced."""
    for r in rules:
        if not r.literals:
            raise ValueError(f"rule {r.name} has no literal token")
    added = ["host", "path", "rule", "reason", "verdict"]
    base = pages.drop(*[c for c in added if c != url]).withColumn("_at", host_path(F.col(url)))
    cut = base.withColumn("_host", F.col("_at.host")).withColumn("_path", F.col("_at.path")).drop("_at")
    urls = cut.select(F.col("_host").alias("host"), F.col("_path").alias("path")).distinct()
    index = rule_index(urls, rules)
    held = [r["token"] for r in index.select("token").distinct().collect()]
    fits = (urls.select("host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
            .where(F.col("token").isin(held)).join(index, "token")
            .where(F.expr("concat(host, path) rlike pattern"))
            .groupBy("host", "path").agg(F.max(F.struct("rank", "rule", "action")).alias("best")))
    judged = cut.join(fits.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best"),
                      ["_host", "_path"], "left")
    best, mine = F.col("best"), [c for c in base.columns if c != "_at"]
    return judged.select(*mine, F.col("_host").alias("host"), F.col("_path").alias("path"),
                         F.when(best["rank"] > 0, best["rule"]).alias("rule"), best["rule"].alias("reason"),
                         F.coalesce(best["action"], F.lit("allow")).alias("verdict"))


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """The same rows in DuckDB, every rule tried on every URL."""
    base = sorted((r for r in RULES if r.rank), key=lambda r: (-r.rank, r.name))
    fit = {r.name: f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '/{p}')"
           for r in base for h, _, p in [r.name.partition("/")]}
    rule = "CASE " + " ".join(f"WHEN {fit[r.name]} THEN '{r.name}'" for r in base) + " END"
    act = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN '{r.action}'" for r in base) + " END"
    word = "regexp_matches(host, '(^|[.-])(" + "|".join(BLOCK_WORDS) + ")([.:-]|$)')"
    pair = "regexp_matches(host, '(^|[.-])(" + "|".join(f"{a}[-_]?{b}" for a, b in BLOCK_PAIRS) + ")([.:-]|$)')"
    return rf"""
    WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
    p AS (SELECT page_id, translate(coalesce(raw, ''), '{UPPER}', '{LOWER}') AS host,
                 coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
    r AS (SELECT *, {rule} AS rule FROM p)
    SELECT page_id, host, path, rule, coalesce({act}, CASE WHEN {word} OR {pair} THEN 'block' ELSE 'allow' END) AS verdict FROM r"""

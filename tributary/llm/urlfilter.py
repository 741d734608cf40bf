"""URL filters: pattern rules indexed by their rarest literal token. DataFrame and SQL functions only.

A pattern rule has a regular expression and the literal tokens (runs of ``a-z0-9`` in the lower-cased url)
without which it can't match. Tokens are counted over all urls; each rule is filed under the token of its own
that fewest urls have; rules without a token are candidates for every url. A url's tokens fetch the rules filed under
them, and only those run their expressions. The verdict is ``block`` if a rule that blocks matches, else ``allow``.

Host rules come on top: one fits its host and all subdomains if the path starts with its own path; the longest
wins (of equal ones the first given) and overrides the patterns. Null urls and urls without ``://`` have empty host
and path, and no rule. Repeated rows are judged alike; an empty table gives an empty result; other columns, whatever
their names, are ignored.

Rules are given by the caller. Up to ``INLINE`` of a sort go into the plan as literals, patterns as a map from token
to rules: one narrow pass, no shuffle, no join. Beyond that they are tables: exploded tokens (or a host's suffixes)
meet them in equi-joins over distinct urls, so any number of rules is judged exactly. There is no bound on rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INLINE = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str = "block"


HOST_RULES = (
    HostRule("allow", "com"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
PATTERN_RULES = (
    PatternRule("spam-farm", "(^|[^a-z0-9])spam-farm([^a-z0-9]|$)", ("spam", "farm")),
    PatternRule("cheap-pills", "(^|[^a-z0-9])cheap-pills([^a-z0-9]|$)", ("cheap", "pills")),
    PatternRule("casino-bonus", "[./-]casino[./-].*[^a-z0-9]bonus([^a-z0-9]|$)", ("casino", "bonus")),
    PatternRule("login-form", "/wp-login[.]php([?#]|$)", ("wp", "login", "php")),
    PatternRule("binary", "[.]exe([?#]|$)", ("exe",)),
    PatternRule("session-id", "[?&]sessionid=[a-z0-9]+", ("sessionid",)),
)


def lowered(url: Column) -> Column:
    return F.translate(url, UPPER, LOWER)


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(lowered(url), F.lit("")), F.lit("([a-z0-9]+)"), F.lit(1)))


def host_of(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def filed(urls: DataFrame, rules: tuple[PatternRule, ...]) -> list[tuple[str | None, PatternRule]]:
    """Each rule with the token it is filed under: the one in fewest urls, first in order on ties; None without tokens."""
    names = sorted({t for r in rules for t in r.tokens})
    if not names:
        return [(None, r) for r in rules]
    met = urls.select(F.explode(tokens_of(F.col("url"))).alias("token"))
    if len(names) <= INLINE:
        met = met.where(F.col("token").isin(names))
    else:
        met = met.join(urls.sparkSession.createDataFrame([(n,) for n in names], "token string"), "token", "left_semi")
    n = {r["token"]: r["n"] for r in met.groupBy("token").agg(F.count("*").alias("n")).collect()}  # at most the rules' tokens
    return [(min(r.tokens, key=lambda t: n.get(t, 0)) if r.tokens else None, r) for r in rules]


HITS = "array<struct<at:int,name:string,pattern:string,verdict:string>>"


def _literal(rules: list[tuple[int, PatternRule]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("at"), F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict")) for i, r in rules]).cast(HITS)


def pattern_hits(out: DataFrame, index: list[tuple[str | None, PatternRule]]) -> DataFrame:
    """``out (url, low, tokens)`` with ``hits``, the matching rules in the order they were given."""
    by: dict[str | None, list[tuple[int, PatternRule]]] = {}
    for i, (token, r) in enumerate(index):
        by.setdefault(token, []).append((i, r))
    always = _literal(by.pop(None, []))
    match = lambda rules: F.filter(rules, lambda r: F.rlike(F.col("low"), r["pattern"]))
    if len(index) <= INLINE:
        fetched = always
        if by:
            table = F.create_map(*[x for t, rules in by.items() for x in (F.lit(t), _literal(rules))])
            fetch = lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast(HITS))
            fetched = F.concat(always, F.flatten(F.transform("tokens", fetch)))
        return out.withColumn("hits", F.array_sort(match(fetched)))
    rows = [(t, i, r.name, r.pattern, r.verdict) for t, rules in by.items() for i, r in rules]
    table = out.sparkSession.createDataFrame(rows, "token string, at int, name string, pattern string, verdict string")
    met = out.where("url is not null").select("url", "low", "tokens").distinct().select("url", "low", F.explode("tokens").alias("token")).join(table, "token").where(F.rlike(F.col("low"), F.col("pattern")))
    met = met.groupBy("url").agg(F.collect_list(F.struct("at", "name", "pattern", "verdict")).alias("met"))
    found = out.join(met, "url", "left")
    return found.withColumn("hits", F.array_sort(F.concat(match(always), F.coalesce("met", F.array().cast(HITS))))).drop("met")


def host_rule(out: DataFrame, hosts: tuple[HostRule, ...]) -> DataFrame:
    """``out (host, path)`` with ``rule`` and ``ruled``, name and verdict of the longest host rule that fits."""
    if len(hosts) <= INLINE:
        fits = ruled = F.lit(None).cast("string")
        for r in reversed(sorted(hosts, key=lambda r: -len(r.name))):  # the longest, of equal ones the first, is asked first
            hit = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit(f".{r.host}"))) & F.startswith(F.col("path"), F.lit(r.path))
            fits, ruled = F.when(hit, r.name).otherwise(fits), F.when(hit, r.verdict).otherwise(ruled)
        return out.withColumn("rule", fits).withColumn("ruled", ruled)
    rows = [(r.host, r.path, -len(r.name), i, r.name, r.verdict) for i, r in enumerate(hosts)]
    table = out.sparkSession.createDataFrame(rows, "suffix string, lead string, size int, at int, rule string, ruled string")
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = out.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix")).join(table, "suffix").where(F.startswith(F.col("path"), F.col("lead")))
    best = met.groupBy("host", "path").agg(F.min(F.struct("size", "at", "rule", "ruled")).alias("b"))
    return out.join(best.select("host", "path", "b.rule", "b.ruled"), ["host", "path"], "left")


def judge(pages: DataFrame, hosts: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, patterns)`` for every row of ``pages (page_id, url)``."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    index = filed(rows, patterns)
    out = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens_of(F.col("url")).alias("tokens"), F.coalesce(lowered(F.col("url")), F.lit("")).alias("low"))
    out = host_rule(pattern_hits(out, index), hosts)
    own = F.when(F.exists("hits", lambda r: r["verdict"] == "block"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.array_join(F.transform("hits", lambda r: r["name"]), ",").alias("patterns"))


#: The same over ``pages`` in DuckDB, with the rules of this module.
SQL = """
WITH u AS (
  SELECT page_id, coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS low,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
    concat_ws(',',
      CASE WHEN regexp_matches(low, '(^|[^a-z0-9])spam-farm([^a-z0-9]|$)') THEN 'spam-farm' END,
      CASE WHEN regexp_matches(low, '(^|[^a-z0-9])cheap-pills([^a-z0-9]|$)') THEN 'cheap-pills' END,
      CASE WHEN regexp_matches(low, '[./-]casino[./-].*[^a-z0-9]bonus([^a-z0-9]|$)') THEN 'casino-bonus' END,
      CASE WHEN regexp_matches(low, '/wp-login[.]php([?#]|$)') THEN 'login-form' END,
      CASE WHEN regexp_matches(low, '[.]exe([?#]|$)') THEN 'binary' END,
      CASE WHEN regexp_matches(low, '[?&]sessionid=[a-z0-9]+') THEN 'session-id' END) AS patterns
  FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN patterns <> '' THEN 'block' ELSE 'allow' END AS verdict, patterns
FROM r
"""

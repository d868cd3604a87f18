"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and a path pattern. Its literal tokens are the runs of letters and digits that a URL which fits must
hold as whole tokens; of these the one that the fewest URLs have is its index key. A URL's tokens fetch the rules
that are filed under one of them, and only those rules run their regular expression. Rules without such a token are
filed under the empty token, which every URL has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this number (and so up to a few MB) are broadcast; more are joined by shuffle.
BROADCAST_RULES = 20_000
TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """action: allow or block. A host rule fits its host and subdomains, and paths that start with its path; a rule
    without a host fits any URL (after the scheme, lower-cased) in which its pattern occurs, * standing for anything."""

    action: str
    host: str | None
    path: str

    @property
    def name(self) -> str:
        return f"{self.host or ''}{self.path}"

    def regex(self) -> str:
        """For host + path + rest of the URL, lower-cased before the path."""
        wild = ".*".join(re.escape(p) for p in self.path.split("*"))
        return rf"(?s)^(?:[^/?#]*\.)?{re.escape(self.host)}{wild}" if self.host is not None else f"(?s){wild}"

    def tokens(self) -> list[str]:
        """Tokens that every URL that fits has. In a path pattern a run counts only if literal text bounds it on both
        sides: the last run of a prefix may go on in the URL."""
        found = re.findall(TOKEN, self.host or "")
        for literal in self.path.split("*"):
            found += [m.group() for m in re.finditer(TOKEN, literal.lower()) if m.start() > 0 and m.end() < len(literal)]
        return list(dict.fromkeys(found))


#: The contract's rules.
HOST_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]
#: What decides where no host rule fits: addresses that are seldom prose. None of them: allow.
PATTERN_RULES = [
    Rule("block", None, "/login/"),
    Rule("block", None, "/cart/"),
    Rule("block", None, "/ads/"),
    Rule("block", None, "&sessionid="),
    Rule("block", None, "?utm_source=feed"),
    Rule("allow", None, "/*/archive/"),
]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ? or #. Null or no
    ://: both empty."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.regexp_extract(text, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(text: Column) -> Column:
    """A URL's distinct tokens, and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))))


def filed(spark, rules: list[Rule], urls: DataFrame) -> DataFrame:
    """rule_no, action, name, host_rule, weight, regex and the token each rule is filed under: its rarest among urls
    (column tokens). Tokens that no rule has are dropped before they are counted."""
    made = [(n, r.action, r.name, r.host is not None, len(r.name), r.regex(), r.tokens() or [""]) for n, r in enumerate(rules)]
    table = spark.createDataFrame(made, "rule_no int, action string, name string, host_rule boolean, weight int, regex string, tokens array<string>")
    own = table.select("rule_no", F.explode("tokens").alias("token"))
    wanted = own.select("token").distinct()
    seen = urls.select(F.explode("tokens").alias("token")).join(_small(wanted, len(rules)), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = own.join(seen, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("m"))
    return table.join(rarest, "rule_no").select("rule_no", "action", "name", "host_rule", "weight", "regex", F.col("m.token").alias("token"))


def _small(df: DataFrame, rules: int) -> DataFrame:
    return F.broadcast(df) if rules <= BROADCAST_RULES else df


def judge(pages: DataFrame, rules: list[Rule], carry: list[Column], url: str = "url") -> DataFrame:
    """carry columns, host, path, rule (the host rule that fits and is longest, else null), verdict.

    verdict is the rule's action; without one, that of the longest fitting pattern rule; without that, allow. Rules
    of equal length: the one that comes first. Null URLs and those without :// have an empty host and path, no rule,
    and are allowed. Rows are judged each, whatever repeats.
    """
    spark = pages.sparkSession
    host, path = host_and_path(url)
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rows = pages.select(*carry, host.alias("host"), path.alias("path"), F.regexp_extract(text, r"(?s)://[^/?#]*(.*)$", 1).alias("__rest"))
    # only URLs with a scheme have anything to fit
    full = F.when(F.col("host") != "", F.concat("host", "__rest")).otherwise("")
    rows = rows.withColumn("__full", full).withColumn("tokens", tokens(F.col("__full")))
    index = _small(filed(spark, rules, rows), len(rules)).withColumnRenamed("token", "__token")
    if len(rules) <= BROADCAST_RULES:
        # the whole index is small: candidates are looked up where the row is, and rows aren't shuffled
        entries = index.groupBy("__token").agg(F.collect_list(F.struct("weight", (-F.col("rule_no")).alias("order"), "action", "name", "host_rule", "regex")).alias("rules"))
        lookup = entries.agg(F.map_from_entries(F.collect_list(F.struct("__token", "rules"))))
        found = rows.withColumn("index", lookup.scalar())
        candidates = F.flatten(F.transform("tokens", lambda t: F.coalesce(F.try_element_at("index", t), F.array())))
        fits = F.filter(candidates, lambda r: F.regexp_like(F.col("__full"), r["regex"]))
        found = found.withColumn("__fits", fits)
        best = lambda kind: F.array_max(F.filter("__fits", lambda r: r["host_rule"] == kind))
        found = found.withColumn("__rule", best(True)).withColumn("__pattern", best(False))
    else:
        rows = rows.withColumn("__row", F.struct(F.xxhash64("__full"), F.monotonically_increasing_id()))
        hits = rows.select("__row", "__full", F.explode("tokens").alias("__token")).join(index, "__token").where(F.regexp_like("__full", F.col("regex")))
        entry = F.struct("weight", (-F.col("rule_no")).alias("order"), "action", "name")
        ruled = hits.groupBy("__row").agg(F.max(F.when(F.col("host_rule"), entry)).alias("__rule"), F.max(F.when(~F.col("host_rule"), entry)).alias("__pattern"))
        found = rows.join(ruled, "__row", "left")
    names = [c for c in rows.columns if c not in ("__rest", "__full", "tokens", "__row", "index")]
    return found.select(*names, F.col("__rule.name").alias("rule"), F.coalesce("__rule.action", "__pattern.action", F.lit("allow")).alias("verdict"))


def query(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    return judge(pages, HOST_RULES + PATTERN_RULES, [F.col("page_id")])


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule,
  host || substr(rest, length(host) + 1) AS whole FROM h)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
    WHEN rule IS NOT NULL OR host = '' THEN 'allow'
    WHEN contains(whole, '?utm_source=feed') THEN 'block'
    WHEN regexp_matches(whole, '/.*/archive/') THEN 'allow'
    WHEN contains(whole, '&sessionid=') OR contains(whole, '/login/') OR contains(whole, '/cart/') OR contains(whole, '/ads/') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""

"""URL filters: domain/path rules over pattern rules indexed by their rarest token (native).

Two layers. *Pattern rules* are regular expressions with a verdict. Each names
the literal tokens (lower-case runs of letters and digits) that any matching
URL must contain; the rule is indexed under the one of its tokens that is
rarest among the URLs at hand, counted in one map-side combined pass that only
returns the rules' own tokens. A URL's tokens fetch the candidate rules, and only
these run their regular expression. *Domain rules* (host, path prefix) override: the
longest fitting rule wins, and its host key is fetched by the host's suffixes. Both
indexes are one stored table with a row per key, joined on the keys of the URLs: keys
travel without the URL, a small rule table is broadcast by its measured size, and of a
large one a hot token's URLs are split by AQE. Texts meet their candidates by row.

Defined cases: a null URL or one without ``://`` has empty host and path, fits
no domain rule, and is judged by the pattern rules on the empty or whole URL; a
null page_id passes through; repeated rows are judged one by one; of several
matching pattern rules a block beats an allow; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import ascii_lower, stored, table


class DomainRule(NamedTuple):
    verdict: str
    host: str
    path: str                      # without the leading slash

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


class PatternRule(NamedTuple):
    verdict: str
    regex: str                     # over the lower-cased URL
    tokens: tuple[str, ...]        # every match contains these, as whole tokens


DOMAIN_RULES = (
    DomainRule("block", "net", ""), DomainRule("allow", "example.net", "en/"),
    DomainRule("block", "example.com", "de/"), DomainRule("allow", "org", "fr/"),
)

class Family(NamedTuple):
    """Rules of one shape: a rule per pair of an ``a`` and a ``b``."""

    verdict: str
    regex: str                     # with {a} and {b}, each a run of whole tokens
    a: tuple[str, ...]
    b: tuple[str, ...]

    def rules(self) -> list[PatternRule]:
        return [PatternRule(self.verdict, self.regex.format(a=a, b=b), tuple(sorted({*re.split("_", a), *re.split("_", b)})))
                for a in self.a for b in self.b]

    def any_of_them(self) -> str:
        """One regular expression that matches where any rule of the family does."""
        return self.regex.format(a=f"({'|'.join(self.a)})", b=f"({'|'.join(self.b)})")


FAMILIES = (
    # host labels such as cheap-pills or pills-cheap
    Family("block", r"://([^/?#]*[.])?({a}-{b}|{b}-{a})[.]",
           tuple("adult ads best big bonus buy cheap click cool crypto daily diet discount easy extra fake fast free gold "
                 "hot instant live lucky max mega money nude online porn quick real replica rich royal sexy spam super "
                 "top turbo vip viral win xxx".split()),
           tuple("bets bingo brides cams cash casino chips codes coins coupons cracks dating deals downloads escorts farm "
                 "followers gambling games gifts girls hacks jackpot keygen lenders likes links loans lottery meds movies "
                 "offers payday pharmacy pills poker popups prizes proxy rewards rolex serials singles slots spins "
                 "steroids streams surveys torrents track traffic videos viagra warez watches win".split())),
    # query parameters that name a spam source
    Family("block", r"[?&]{a}={b}([^a-z0-9_.%+-]|$)",
           tuple("aff affid campaign click_id partner ref referrer source src utm_campaign utm_medium utm_source".split()),
           tuple("adfly botnet bulk clickbank doorway linkfarm malware mlm parked phish popunder redirect scam scraper "
                 "spam spammer splog spyware typosquat warez".split())),
    # files that count visits
    Family("block", r"/{a}/{b}[.](gif|png|js)",
           tuple("ad ads analytics banner banners beacon pixel stats track tracking".split()),
           tuple("beacon blank clear collect count counter hit pixel spacer tag".split())),
)

PATTERN_RULES = (
    *(r for f in FAMILIES for r in f.rules()),
    PatternRule("block", r"/ads?/banner/", ("banner",)),
    PatternRule("allow", r"://www[.]example[.]org/", ("www", "example", "org")),
)


def host_of(url: Column) -> Column:
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(h)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


def token_counts(urls: DataFrame, url: Column, tokens: Sequence[str]) -> dict[str, int]:
    """URLs holding each of the rules' tokens; at most ``len(tokens)`` rows return."""
    if not tokens:
        return {}
    own = F.array_intersect(tokens_of(url), F.array(*map(F.lit, tokens)))
    got = urls.select(F.explode(own).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in got.collect()}


def rarest_token_index(rules: Sequence[PatternRule], counts: dict[str, int]) -> dict[str, list[int]]:
    """token -> numbers of the rules indexed under it (ties: alphabetical)."""
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
    return index


def suffixes_of(host: Column) -> Column:
    """The host and everything after each of its dots."""
    labels = F.split(host, "[.]")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), ".")))


PATTERN_ENTRY = "struct<block:boolean,regex:string>"
DOMAIN_ENTRY = "struct<size:int,name:string,verdict:string,path:string>"


def _matching(entries: Column, low: Column) -> Column:
    return F.filter(entries, lambda r: F.regexp(low, r["regex"]))


def _fitting(entries: Column, path: Column) -> Column:
    return F.filter(entries, lambda r: F.startswith(path, r["path"]))


def _rule_table(spark: SparkSession, patterns: dict[str, list], domains: dict[str, list]) -> DataFrame:
    """One row per index key: ``t:`` and a token, or ``h:`` and a host."""
    keys = [(f"t:{k}", e, []) for k, e in patterns.items()] + [(f"h:{k}", [], e) for k, e in domains.items()]
    kind = f"array<struct<key:string,patterns:array<{PATTERN_ENTRY}>,domains:array<{DOMAIN_ENTRY}>>>"
    entries = [{"key": k, "patterns": [dict(zip(("block", "regex"), e)) for e in p],
                "domains": [dict(zip(("size", "name", "verdict", "path"), e)) for e in d]} for k, p, d in keys]
    # a literal that the JVM reads itself: a frame from a Python list would start Python workers
    return stored(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(entries)), kind))), "url-rules")


def url_filter(pages: DataFrame, domain_rules: Sequence[DomainRule] = DOMAIN_RULES,
               pattern_rules: Sequence[PatternRule] = PATTERN_RULES, id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (of the domain rule that won), verdict, pattern
    (the regular expression that decided, if one matched)."""
    for r in pattern_rules:
        if not r.tokens or not all(re.fullmatch("[a-z0-9]+", t) for t in r.tokens):
            raise ValueError(f"rule {r.regex!r} needs lower-case literal tokens")
    url = F.col(url_col)
    rows = stored(pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host_of(url).alias("host"),
        path_of(url).alias("path"), ascii_lower(F.coalesce(url, F.lit(""))).alias("low")), "url-rows")
    counts = token_counts(rows, F.col("low"), sorted({t for r in pattern_rules for t in r.tokens}))
    patterns = {t: [(pattern_rules[i].verdict == "block", pattern_rules[i].regex) for i in ids]
                for t, ids in rarest_token_index(pattern_rules, counts).items()}
    domains: dict[str, list] = {}
    for r in domain_rules:
        domains.setdefault(r.host, []).append((len(r.name), r.name, r.verdict, "/" + r.path))

    keys = F.concat(F.transform(tokens_of(F.col("low")), lambda t: F.concat(F.lit("t:"), t)),
                    F.transform(suffixes_of(F.col("host")), lambda h: F.concat(F.lit("h:"), h)))
    fetched = (rows.select("row", F.explode(keys).alias("key"))
               .join(_rule_table(pages.sparkSession, patterns, domains), "key")
               .groupBy("row").agg(F.flatten(F.collect_list("patterns")).alias("patterns"),
                                   F.flatten(F.collect_list("domains")).alias("domains")))
    # structs order by their first field: the longest rule, a block before an allow
    judged = rows.join(fetched, "row", "left").select(
        "page_id", "host", "path", F.array_max(_fitting(F.col("domains"), F.col("path"))).alias("won"),
        F.array_max(_matching(F.col("patterns"), F.col("low"))).alias("hit"))
    by_pattern = F.when(F.col("hit.block"), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("won.name").alias("rule"),
        F.coalesce(F.col("won.verdict"), by_pattern).alias("verdict"), F.col("hit.regex").alias("pattern"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).drop("pattern")


def _sql() -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    of_family = {r for f in FAMILIES for r in f.rules()}
    block = [f.any_of_them() for f in FAMILIES if f.verdict == "block"]
    block += [r.regex for r in PATTERN_RULES if r.verdict == "block" and r not in of_family]
    block = " OR ".join(f"regexp_matches(low, {lit(r)})" for r in block)
    rules = ", ".join(f"({lit(r.name)}, {lit(r.verdict)}, {lit(r.host)}, {lit('/' + r.path)})"
                      for r in DOMAIN_RULES)
    return rf"""
WITH p AS (SELECT page_id, translate(coalesce(url, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}',
                                     'abcdefghijklmnopqrstuvwxyz') AS low,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rule, verdict, rhost, rpath) AS (VALUES {rules}),
f AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule,
             arg_max(verdict, length(rule)) AS verdict
      FROM (SELECT DISTINCT page_id, host, path FROM p) q JOIN r
      ON (q.host = rhost OR ends_with(q.host, '.' || rhost)) AND starts_with(q.path, rpath)
      GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN {block} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f ON p.page_id = f.page_id AND p.host = f.host AND p.path = f.path
"""


SQL = _sql()

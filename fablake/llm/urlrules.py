"""URL filters: pattern rules indexed by their rarest literal token (DataFrame functions only).

A pattern is literal text with ``*`` (anything), ``^`` (a separator or the end) and, in front, ``||`` (the
host's beginning or a subdomain's).  Its literal tokens are the runs of letters and digits that are bounded
on both sides, so a URL that fits must have each of them as a whole token.  Of these the one that the
fewest URLs have becomes the rule's index key; a rule without a token has the empty key, which every URL
carries.  The tokens of each distinct URL fetch candidate rules, and only those run their regular expression.

Address rules (``host/path``) are patterns too, ``||host/path``, and come before other patterns; the
longest wins; the case of their path counts, that of other patterns does not.  Of other patterns an allowing one wins over a blocking one, then the longest.

The rules are an argument, so their number is known: up to ``BROADCAST_RULES`` the index is broadcast,
beyond that the same join shuffles.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fablake.llm.common import table

BROADCAST_RULES = 100_000
FOLDED = "(?i)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlRule(NamedTuple):
    rule: str
    action: str
    address: bool = False

    @property
    def pattern(self) -> str:
        return f"||{self.rule}" if self.address else self.rule

    @property
    def tokens(self) -> list[str]:
        """Bounded runs of letters and digits; a run at the pattern's edge or beside ``*`` may go on."""
        found = re.finditer(r"[A-Za-z0-9]+", self.pattern)
        bounded = [m[0].lower() for m in found if 0 < m.start() and m.end() < len(self.pattern)
                   and self.pattern[m.start() - 1] != "*" and self.pattern[m.end()] != "*"]
        return bounded or [""]

    @property
    def regex(self) -> str:
        body = self.pattern.removeprefix("||")
        parts = {"*": ".*", "^": "(?:[^A-Za-z0-9_.%-]|$)"}
        out = "".join(parts.get(c) or (c if c.isascii() and c.isalnum() else "\\" + c if c.isascii() else c) for c in body)
        out = r"^(?:[^/?#]*\.)?" + out if self.pattern.startswith("||") else out
        return out if self.address else FOLDED + out


ADDRESS_RULES = [
    UrlRule("net/", "block", True),
    UrlRule("example.net/en/", "allow", True),
    UrlRule("example.com/de/", "block", True),
    UrlRule("org/fr/", "allow", True),
]
PATTERN_RULES = [UrlRule(p, "block") for p in (
    "/ads/", "/adserver/", "/banners/", "/click?", "/cgi-bin/", "/wp-login.php^", "/wp-admin/", "/login?", "/cart/", "/checkout/",
    "?sessionid=", "&sessionid=", "?phpsessid=", "&phpsessid=", "?replytocom=", "?page=*&ref=", "/calendar/*/day/", "/casino/",
    "/poker/", "/porn/", "/xxx/", "/viagra/", "||doubleclick.net^", "||googlesyndication.com^", "||adservice.google.com^", "/tag/*/page/",
)] + [UrlRule(p, "allow") for p in ("/login?returnto=*wiki", "||archive.org^")]


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """(host with A-Z lower-cased, path, host and all that follows); empty without ``://`` or url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path, F.concat(host, F.regexp_extract(rest, r"^[^/?#]*((?s:.*))", 1))


def _rules(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    rows = [(r.rule, r.regex, r.action, r.address, len(r.rule), r.tokens) for r in rules]
    return spark.createDataFrame(rows, "rule string, regex string, action string, address boolean, length int, tokens array<string>")


def judge_urls(pages: DataFrame, rules: list[UrlRule], default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (the address rule that decided, else null), pattern (the other
    pattern that decided, else null) and verdict, one row for each row.

    A null url, or one without ``://``, has an empty host and path, fits no address rule and gets the
    default unless a pattern without anchor fits the empty text.  Input columns of these five names are
    replaced; rows, their other columns and repeated rows stay as they are.
    """
    spark = pages.sparkSession
    bounded = (lambda df: F.broadcast(df)) if len(rules) <= BROADCAST_RULES else (lambda df: df)
    host, path, target = host_and_path(F.col("url"))
    urls = pages.select("url").distinct().select("url", target.alias("target"))
    tokens = urls.select("url", "target", F.explode(F.array_union(
        F.array(F.lit("")), F.split(F.translate("target", UPPER, LOWER), "[^a-z0-9]+"))).alias("token"))

    table_ = _rules(spark, rules)
    wanted = table_.select(F.explode("tokens").alias("token")).distinct()
    counts = tokens.join(bounded(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    index = table_.withColumn("token", F.explode("tokens")).join(counts, "token", "left").groupBy(
        "rule", "regex", "action", "address", "length").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))

    fits = tokens.join(bounded(index), "token").filter(F.rlike("target", F.col("regex")))
    rank = F.struct("address", (~F.col("address") & (F.col("action") == "allow")).alias("excepts"), "length", "rule")
    best = fits.groupBy("url").agg(F.max_by(F.struct("rule", "action", "address"), rank).alias("best"))
    best = best.withColumnRenamed("url", "_url")

    rows = pages.drop("host", "path", "rule", "pattern", "verdict")
    judged = rows.join(best, rows["url"].eqNullSafe(best["_url"]), "left")
    return judged.select(
        *[judged[c] for c in rows.columns], host.alias("host"), path.alias("path"),
        F.when(F.col("best.address"), F.col("best.rule")).alias("rule"),
        F.when(~F.col("best.address"), F.col("best.rule")).alias("pattern"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, ADDRESS_RULES + PATTERN_RULES).select("page_id", "host", "path", "rule", "verdict", "pattern")


def _oracle() -> str:
    values = ", ".join(f"('{r.rule}', '{r.regex}', '{r.action}', {r.address}, {len(r.rule)})" for r in ADDRESS_RULES + PATTERN_RULES)
    return rf"""
WITH rules(rule, regex, action, address, length) AS (VALUES {values}),
r AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*((?s:.*))', 1) AS tail
  FROM r),
m AS (
  SELECT page_id, rules.*, row_number() OVER (PARTITION BY page_id
    ORDER BY address DESC, (NOT address AND action = 'allow') DESC, length DESC, rule DESC) AS k
  FROM p JOIN rules ON regexp_matches(host || tail, regex))
SELECT p.page_id, host, path, CASE WHEN address THEN rule END AS rule, CASE WHEN NOT address THEN rule END AS pattern,
       coalesce(action, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND k = 1
"""


ORACLE = _oracle()

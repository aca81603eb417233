"""URL verdicts by rules that are indexed under their rarest literal token.

Every rule is a regular expression over ``host + path`` with the literal tokens any match must hold.
Tokens are counted over all urls; a rule is filed under its rarest one. A url's tokens fetch candidate
rules from that index, and only those run their expression. Host rules (``example.com/en/``) fit the host
and its subdomains when the path starts with theirs, and the longest wins; without one, pattern rules
decide: any that fits blocks, else the url is allowed. DataFrame functions only, no Python on the path.

Edge cases: a url that is null or has no ``://`` has an empty host and path; it fits no rule and is
allowed. Host rules of equal length: block before allow, then by name. Repeated rows each get their own
result row. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded
from .decontaminate import lower_ascii

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``tokens`` must stand as whole tokens in each url that ``pattern`` matches."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    is_host_rule: bool = False


def host_rule(verdict: str, name: str) -> Rule:
    host, slash, path = name.partition("/")
    host = host.lower()
    prefix = slash + path
    # A token at the open end of the path may go on in the url, so it can't be looked up.
    closed = _TOKEN.findall(host if not slash else host + re.sub(r"[A-Za-z0-9]+\Z", "", prefix).lower())
    quoted = "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in host), "".join(
        c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in prefix)
    end = "" if slash else "(/|$)"
    return Rule(name, verdict, rf"^([^/]*\.)?{quoted[0]}{quoted[1]}{end}", tuple(closed), True)


# Pattern rules of the default filter.
PATTERNS = tuple(Rule(n, "block", p, t) for n, p, t in (
    ("spam-farm", r"^([^/]*\.)?spam-farm\.", ("spam", "farm")),
    ("casino", r"^([^/]*[.-])?casino[.-]", ("casino",)),
    ("poker", r"^([^/]*[.-])?poker[.-]", ("poker",)),
    ("adult", r"^([^/]*[.-])?(adult)[.-]", ("adult",)),
    ("porn", r"[./-]porn[./-]", ("porn",)),
    ("xxx", r"^([^/]*\.)?xxx\.", ("xxx",)),
    ("login", r"/login(/|$)", ("login",)),
    ("wp-admin", r"/wp-admin(/|$)", ("wp", "admin")),
    ("cgi-bin", r"/cgi-bin/", ("cgi", "bin")),
    ("calendar", r"/calendar/[0-9]{4}/", ("calendar",)),
))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(raw), F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)


def _exploded(pages: DataFrame) -> DataFrame:
    """One row per distinct token of a url, and one with the empty token for the url itself."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.spark_partition_id().alias("place"),
                        host.alias("host"), path.alias("path"))
    rows = rows.withColumn("target", F.concat("host", "path"))
    tokens = F.array_union(F.split(lower_ascii(F.col("target")), "[^a-z0-9]+"), F.array(F.lit("")))
    return rows.withColumn("token", F.explode(tokens))


def verdicts(pages: DataFrame, host_rules: tuple[Rule, ...], patterns: tuple[Rule, ...] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule (the host rule, else null), verdict, pattern (what blocked without a rule)."""
    spark = pages.sparkSession
    rules = [*host_rules, *patterns]
    table = spark.createDataFrame(
        [(i, r.name, r.verdict, r.pattern, list(r.tokens), r.is_host_rule) for i, r in enumerate(rules)],
        "id int, name string, verdict string, pattern string, tokens array<string>, is_host_rule boolean")
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    seen = (_exploded(pages).join(bounded(wanted, len(rules)), "token").groupBy("token").agg(F.count(F.lit(1)).alias("seen")))
    listed = (table.select("id", F.explode("tokens").alias("token")).join(seen, "token", "left")
              .groupBy("id").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)), F.col("token").alias("token"))).alias("rarest")))
    # A rule without a usable token is tried on every url, under the empty token each url has.
    index = table.join(listed, "id", "left").select(
        F.coalesce("rarest.token", F.lit("")).alias("token"), F.lit(False).alias("is_mark"), "name", "verdict", "pattern", "is_host_rule")
    mark = spark.range(1).select(F.lit("").alias("token"), F.lit(True).alias("is_mark"), F.lit("").alias("name"),
                                 F.lit("").alias("verdict"), F.lit("").alias("pattern"), F.lit(False).alias("is_host_rule"))
    index = bounded(index.unionByName(mark), len(rules) + 1)
    fitting = _exploded(pages).join(index, "token").where("is_mark OR rlike(target, pattern)")
    rank = F.struct(F.length("name"), (F.col("verdict") == "block").alias("blocks"), F.col("name").alias("name"), F.col("verdict").alias("verdict"))
    found = fitting.groupBy("page_id", "url", "host", "path", "place").agg(
        F.count_if("is_mark").alias("copies"),
        F.max(F.when(F.col("is_host_rule"), rank)).alias("rule"),
        F.max(F.when(~F.col("is_mark") & ~F.col("is_host_rule"), rank)).alias("other"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return each.select("page_id", "host", "path", F.col("rule.name").alias("rule"),
                       F.coalesce("rule.verdict", "other.verdict", F.lit("allow")).alias("verdict"),
                       F.when(F.col("rule").isNull(), F.col("other.name")).alias("pattern"))


# Fixed values of the contract.
RULES = (host_rule("allow", "com/"), host_rule("block", "example.com/en/"), host_rule("allow", "www.example.com/en/"),
         host_rule("block", "net/es/"), host_rule("block", "net/fr/"))


def oracle(rules: tuple[Rule, ...] = RULES, patterns: tuple[Rule, ...] = PATTERNS) -> str:
    """The verdicts in DuckDB, by trying each rule on each url."""
    def listing(chosen):
        return ", ".join(f"({name}, '{r.verdict}', {host}, {path}, {pattern})" for r in chosen for name, host, path, pattern in [
            (f"'{r.name}'", f"'{r.name.partition('/')[0]}'", f"'/{r.name.partition('/')[2]}'", f"'{r.pattern}'")])
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH cut AS (SELECT row_number() OVER () AS row_no, page_id,
                 CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
    seen AS (SELECT row_no, page_id, translate(raw, '{upper}', '{small}') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
    rules(name, verdict, rule_host, rule_path, pattern) AS (VALUES {listing(rules)}),
    patterns(name, verdict, rule_host, rule_path, pattern) AS (VALUES {listing(patterns)}),
    fits AS (SELECT row_no, arg_max(name, length(name)) AS rule, arg_max(verdict, length(name)) AS verdict FROM seen, rules
             WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row_no),
    blocked AS (SELECT row_no, list(name ORDER BY length(name) DESC, name DESC)[1] AS pattern FROM seen, patterns
                WHERE regexp_matches(host || path, pattern) GROUP BY row_no)
    SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
           CASE WHEN rule IS NULL THEN pattern END AS pattern
    FROM seen LEFT JOIN fits USING (row_no) LEFT JOIN blocked USING (row_no)"""

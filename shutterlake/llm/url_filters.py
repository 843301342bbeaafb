"""URL filters by pattern rules under their rarest token (operator 1), DataFrame functions only.

A rule has a host, a path pattern in which * stands for anything, a verdict and a
tier. It fits its host and all subdomains (host * fits all) if the url's path
starts with the pattern. Each rule is turned into a regular expression and filed
under one literal token that every url it fits must have: a label of its host or
a word of its path with marks on both sides. Of these the one rarest among the
urls is taken, so a url's tokens fetch few rules, and only those run their
expression. Rules without such a token are filed under the empty token, which
every url has.

Of the rules that fit, the lowest tier wins, then the longest rule, then block,
then the first by name; with none, the default.

Urls are judged by value: a url that a third of the rows share is one row after
the partial aggregation, and the judged urls are written before they are joined
back, so that Spark can split the hot one. The rule table is broadcast only if
Spark finds it small.

Defined results: a null url, or one without ://, has an empty host and path, and
gets the default unless a rule fits those; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.text import UPPER, ascii_lower, table
from shutterlake.session import materialize

#: Fixed values: (host, path, verdict) of the listed rules.
LISTED = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Patterns for urls without a listed rule: pages that hold no prose.
PATTERNS = (
    ("*", "*/login/", "block"),
    ("*", "*/signup/", "block"),
    ("*", "*/cart/", "block"),
    ("*", "*/checkout/", "block"),
    ("*", "*/ads/", "block"),
    ("*", "*/tag/*/feed/", "block"),
    ("*", "*/wp-admin/", "block"),
    ("*", "*/search/", "block"),
)
DEFAULT = "allow"

RULE_SCHEMA = "host string, path string, verdict string, tier int"


def host_of(url: Column) -> Column:
    """Lower-cased (A to Z) text between the first :// and the next / ? # or end; else empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or end; else empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tagged(tag: str, tokens: Column) -> Column:
    return F.transform(F.filter(tokens, lambda t: t != ""), lambda t: F.concat(F.lit(tag), t))


def _url_tokens() -> Column:
    return F.array_distinct(
        F.concat(
            F.array(F.lit("")),
            _tagged("h:", F.split("host", r"\.")),
            _tagged("p:", F.regexp_extract_all(F.col("path"), F.lit("[A-Za-z0-9]+"), F.lit(0))),
        )
    )


def _expression() -> Column:
    def quoted(c: Column) -> Column:
        return F.regexp_replace(c, r"([^A-Za-z0-9*])", r"\\$1")

    host = F.when(F.col("host") == "*", F.lit("[^/]*")).otherwise(
        F.concat(F.lit(r"(?:[^/]*\.)?"), quoted(F.col("host")))
    )
    return F.concat(F.lit("(?s)^"), host, F.regexp_replace(quoted(F.col("path")), r"\*", ".*"))


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, tier, rule, verdict, expression): each rule once, under its rarest token among `urls` (host, path)."""
    every = rules.distinct().select(
        F.concat(F.when(F.col("host") == "*", F.lit("")).otherwise(F.col("host")), "path").alias("rule"),
        "verdict",
        "tier",
        _expression().alias("expression"),
        F.concat(
            F.when(F.col("host") == "*", F.array().cast("array<string>")).otherwise(
                _tagged("h:", F.split("host", r"\."))
            ),
            _tagged(
                "p:",
                F.regexp_extract_all(F.col("path"), F.lit("(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])"), F.lit(0)),
            ),
        ).alias("tokens"),
    )
    every = materialize(every)
    wanted = every.select(F.explode("tokens").alias("token")).distinct()
    often = (
        urls.select(F.explode(_url_tokens()).alias("token"))
        .join(wanted, "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    filed = (
        every.select("*", F.explode_outer("tokens").alias("token"))
        .join(often, "token", "left")
        .groupBy("tier", "rule", "verdict", "expression")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("x"))
    )
    return materialize(filed.select(F.coalesce("x.token", F.lit("")).alias("token"), "tier", "rule", "verdict", "expression"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """(row, host, path, tier, rule, verdict) per input row; tier and rule are null if only the default fits."""
    held = pages.select(
        F.struct(*[pages[c] for c in pages.columns]).alias("row"),
        host_of(pages[url]).alias("host"),
        path_of(pages[url]).alias("path"),
    )
    urls = held.select("host", "path")
    index = index_rules(rules, urls)
    fits = (
        urls.withColumn("token", F.explode(_url_tokens()))
        .join(index, "token")
        .where(F.regexp_like(F.concat("host", "path"), F.col("expression")))
    )
    order = F.struct("tier", (-F.length("rule")).alias("l"), (F.col("verdict") != "block").alias("v"), "rule", "verdict")
    judged = materialize(fits.groupBy("host", "path").agg(F.min(order).alias("won")))
    return held.join(judged, ["host", "path"], "left").select(
        "row", "host", "path",
        F.col("won.tier").alias("tier"),
        F.col("won.rule").alias("rule"),
        F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
    )


def rule_table(spark: SparkSession, tiers: Sequence[Sequence[tuple[str, str, str]]]) -> DataFrame:
    rows = [(h, p, v, t) for t, rules in enumerate(tiers) for h, p, v in rules]
    values = F.array(*[F.struct(*[F.lit(x) for x in r]) for r in rows]).cast(f"array<struct<{RULE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    return spark.range(1).select(F.inline(values))


def query(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    out = judge(pages, rule_table(spark, (LISTED, PATTERNS)))
    listed = F.col("tier") == 0
    return out.select("row.page_id", "host", "path", F.when(listed, F.col("rule")).alias("rule"), "verdict")


def _values(rules: Sequence[tuple[str, str, str]]) -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)


SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
listed(h, r, verdict) AS (VALUES {_values(LISTED)}),
patterns(h, r, verdict) AS (VALUES {_values(PATTERNS)}),
fit AS (
  SELECT page_id, arg_max(h || r, length(h || r)) AS rule, arg_max(verdict, length(h || r)) AS verdict
  FROM p JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r) GROUP BY page_id),
more AS (
  SELECT page_id, arg_max(verdict, length(r)) AS verdict
  FROM p JOIN patterns ON path LIKE replace(r, '*', '%') || '%' GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(fit.verdict, more.verdict, '{DEFAULT}') AS verdict
FROM p LEFT JOIN fit USING (page_id) LEFT JOIN more USING (page_id)
"""

"""URL rules with redirect equivalence, in DataFrame operations only.

Rules judge a url by host suffix and path prefix. Pages also point at other urls for the same content: canonical links
and refresh redirects. Distributed connected components over those edges make alias groups, and a group's decision
reaches the members no rule fits: an explicit allow anywhere in the group wins over a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict): host and path prefix of the registered query
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LINK = r"(?i)<link\b[^>]*>"
META = r"(?i)<meta\b[^>]*>"
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
BASE = r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
#: fixed values: character references of the signs that urls hold
REFERENCES = {"&#(?:38|[xX]26);": "&amp;", "&#(?:47|[xX]2[fF]);|&sol;": "/", "&#(?:58|[xX]3[aA]);|&colon;": ":", "&#(?:46|[xX]2[eE]);|&period;": ".", "&#(?:63|[xX]3[fF]);|&quest;": "?", "&#(?:61|[xX]3[dD]);|&equals;": "=", "&#(?:35|[xX]23);|&num;": "#", "&#(?:45|[xX]2[dD]);": "-", "&#(?:95|[xX]5[fF]);|&lowbar;": "_", "&amp;": "&"}
REFRESH = r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)"""


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first '://' up to '/', '?', '#'; then up to '?', '#'. Both empty for null or no '://'."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none; equal lengths: allow first, then by name."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[1] != "allow", r[0]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in reversed(ordered):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def plain_path(path: Column) -> Column:
    """A path without its '.' and '..' segments."""

    def flat(segments: Column) -> Column:
        kept = F.aggregate(
            F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"),
            lambda up, s: F.when(s == "..", F.slice(up, F.lit(1), F.greatest(F.size(up) - 1, F.lit(0)))).when(s == ".", up).otherwise(F.concat(up, F.array(s))),
        )
        ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, ended), "/"))

    return F.transform(F.array(path), lambda p: F.when(p.contains("/."), F.transform(F.array(F.split(p, "/")), flat)[0]).otherwise(p))[0]  # each names its input once


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1), F.lit(""))


def node(url: Column) -> Column:
    """Name of a url among aliases: scheme, fragment and dot segments dropped, host in lower case, query kept; null without a host."""
    host, path = parts(url)
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(plain_path(path)), query_of(url)))


def resolve(to: Column, url: Column) -> Column:
    """The url that reference ``to`` names on page ``url`` (RFC 3986, dot segments left to ``node``); null for '', other schemes, no base."""
    root, path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*", 0), parts(url)[1]
    here = F.concat(root, F.when(path == "", F.lit("/")).otherwise(path))
    named = F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(F.lit("http:"), to))
    own = F.when(to.startswith("/"), F.concat(root, to)).when(to.startswith("?"), F.concat(here, to)).when(to.startswith("#"), F.concat(here, query_of(url)))
    own = own.otherwise(F.concat(F.regexp_replace(here, r"[^/]*$", ""), to))
    return F.coalesce(named, F.when((root != "") & (to != "") & ~to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), own))


def decoded(text: Column) -> Column:
    """A url from markup: character references of the signs that urls hold become those; others stay."""
    for reference, sign in REFERENCES.items():
        text = F.regexp_replace(text, reference, sign)
    return text


def page_edges(pages: DataFrame) -> DataFrame:
    """(source, target) nodes of canonical links and refresh redirects that pages declare, relative to <base> or the page's url.

    Comments, scripts and styles declare nothing.
    """
    tags = F.filter(F.regexp_extract_all("html", F.lit(LINK), F.lit(0)), lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""))
    hops = F.filter(F.regexp_extract_all("html", F.lit(META), F.lit(0)), lambda t: t.rlike(r"""(?i)http-equiv\s*=\s*["']?refresh"""))
    marked = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.regexp_replace("html", UNSEEN, " ").alias("html"))
    named = F.concat(F.transform(tags, lambda t: F.regexp_extract(t, HREF, 1)), F.transform(hops, lambda t: F.regexp_extract(t, REFRESH, 1)))
    own = F.array(decoded(F.regexp_extract("html", BASE, 1)))
    base = F.transform(own, lambda b: F.coalesce(resolve(b, F.col("url")), F.col("url")))[0]  # as below, an expression that names its input often gets it by a lambda
    found = marked.select("url", F.explode(F.transform(named, lambda t: F.struct(decoded(t).alias("to"), base.alias("base")))).alias("at"))
    target = F.transform(F.transform(F.array("at"), lambda at: resolve(at["to"], at["base"])), node)[0]
    return found.select(F.transform(F.array("url"), node)[0].alias("source"), target.alias("target")).where("source is not null and target is not null and source <> target").distinct()


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``edges`` (source, target urls) are redirects known from elsewhere, e.g. a crawl log. A null url has empty host and
    path, fits no rule, has no alias and gets ``default``. Repeated pages are each judged. Components run only over the
    nodes that edges name; groups of any size propagate by aggregation and join, so a hub of a third of all pages is
    no task's burden. Rules become one CASE expression; they are code, not data, so their number is the caller's.
    """
    host, path = parts(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    links = page_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(node(F.col("source")).alias("source"), node(F.col("target")).alias("target"))).where("source is not null and target is not null")
    links = materialise(links, "aliases")
    shown = ["page_id", "host", "path", F.col("r.rule").alias("rule")]
    if links.isEmpty():
        return judged.select(*shown, F.coalesce("r.verdict", F.lit(default)).alias("verdict"))
    groups = components(links)
    at, to = parts(F.concat(F.lit("x://"), F.col("node")))
    seen = groups.withColumn("verdict", rule_of(at, to, rules)["verdict"])
    ruled = seen.where("verdict is not null").groupBy("component").agg(F.min("verdict").alias("group_verdict"))  # 'allow' < 'block'
    answer = materialise(groups.join(ruled, "component").select("node", "group_verdict"), "verdicts")
    rows = judged.withColumn("node", F.when(F.col("r").isNull(), node(F.col("url"))))
    return rows.join(answer, "node", "left").select(*shown, F.coalesce("r.verdict", "group_verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"))


_PARTS = r"""
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path"""
_RULE = """CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END"""
SQL = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, {_PARTS}
  FROM (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
n AS (
  SELECT *, {_RULE} AS rule,
    CASE WHEN host <> '' THEN host || (CASE WHEN path = '' THEN '/' ELSE path END) || regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1) END AS node
  FROM p),
raw AS (
  SELECT node AS source, replace(href, '&amp;', '&') AS href, regexp_extract(url, '^[^:/?#]+://[^/?#]*', 0) AS base
  FROM (SELECT node, url, regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS href
        FROM (SELECT node, url, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*>')) AS tag FROM n)
        WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')
        UNION ALL
        SELECT node, url, regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)
        FROM (SELECT node, url, unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*>')) AS tag FROM n)
        WHERE regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh'))),
whole AS (
  SELECT source, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN 'http:' || href
    WHEN starts_with(href, '/') THEN base || href END AS url FROM raw),
target AS (
  SELECT source, url, {_PARTS} FROM (SELECT *, substr(url, instr(url, '://') + 3) AS rest FROM whole WHERE url IS NOT NULL)),
edge AS (
  SELECT DISTINCT source, host || (CASE WHEN path = '' THEN '/' ELSE path END) || regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1) AS target
  FROM target WHERE source IS NOT NULL AND host <> ''),
both_ways AS (SELECT source AS a, target AS b FROM edge UNION SELECT target, source FROM edge),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
ruled AS (
  SELECT a, min(CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' ELSE 'block' END) AS verdict
  FROM (SELECT a, {_RULE} AS rule FROM (SELECT a, {_PARTS} FROM (SELECT a, b AS rest FROM reach)))
  WHERE rule IS NOT NULL GROUP BY a)
SELECT n.page_id, n.host, n.path, n.rule,
  CASE WHEN n.rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN n.rule IS NOT NULL THEN 'block' ELSE coalesce(ruled.verdict, 'allow') END AS verdict
FROM n LEFT JOIN ruled ON ruled.a = n.node
"""

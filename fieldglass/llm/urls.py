"""URL filters that hold across redirects and canonical links.

A rule list (allow or block; host and path) gives the verdict of every url that a rule fits. Urls are joined into
classes by redirect edges, canonical links in pages (several, relative and in any letter case) and sameness up to the fragment; the classes are
connected components. A url without a rule takes its class's decision: *allow* if any url of the class is allowed by
a rule (an explicit allow takes precedence), else *block* if any is blocked, else ``default``. A
url's own rule always holds, so a block never reaches a page that is explicitly allowed.

Nulls and edges: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the default;
repeated urls get the same verdict; an empty table or rule list gives an empty result or defaults; columns
other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import materialize
from fieldglass.llm.components import components

#: Fixed value: the parts of a url after its first ``://``: host, path.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """The host with A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def absolute(link: Column, base: Column) -> Column:
    """A link as an absolute url, seen from the page ``base``; null for one to the page itself, without a host, or of another kind (``mailto:``)."""
    bare = F.regexp_extract(base, r"^[^?#]*", 0)
    site = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0)
    folder = F.when(bare == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_replace(bare, "[^/]*$", ""))
    whole = (
        F.when((site == "") | (link == "") | link.startswith("#"), F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(link.contains("://"), link))
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^[^:/?#]+:", 0), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(bare, link))
        .otherwise(F.concat(folder, link))
    )
    parts = r"^([^:/?#]+://[^/?#]*)([^?#]*)(.*)$"
    empty = F.array().cast("array<string>")
    steps = F.aggregate(F.split(F.regexp_extract(whole, parts, 2), "/", -1), empty, lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    return F.when(whole.rlike(r"/\.\.?(/|\?|#|$)"), F.concat(F.regexp_extract(whole, parts, 1), F.array_join(steps, "/"), F.regexp_extract(whole, parts, 3))).otherwise(whole)


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): each page's canonical links and its meta-refresh redirects, in any letter case, relative ones seen from the page's url."""
    html, low = F.col(html_col), F.lower(html_col)
    found = lambda word, tag, value: F.when(low.contains(word), F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, value, 1)))
    canonical = found("canonical", r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = found("refresh", r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    none = F.array().cast("array<string>")
    links = pages.select(F.col(url_col).alias("a"), F.explode(F.concat(F.coalesce(canonical, none), F.coalesce(refresh, none))).alias("b"))
    return links.select("a", absolute(F.regexp_replace("b", "&amp;", "&"), F.col("a")).alias("b")).filter("b is not null").distinct()


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, host, path, rule, verdict for distinct urls: the longest rule (then the smallest) that fits, else nulls.

    Each host yields its suffixes at label borders, a handful of rows, which meet the rules in an equi-join; so rule lists of any size work.
    """
    named = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = named.filter("host <> ''").select("url", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    listed = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), F.col("verdict"), F.concat("host", "path").alias("rule"))
    fits = suffixes.join(listed, "suffix").filter(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("url").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("best"))
    return named.join(best.select("url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")), "url", "left")


def _bare(url: str) -> Column:
    """A url's node in the graph: itself without fragment."""
    return F.substring_index(url, "#", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, url, host, path, rule, verdict, class_verdict: one row a page. ``edges`` has columns a, b (urls)."""
    ends = edges.select(F.col("a").alias("url")).unionByName(edges.select(F.col("b").alias("url")))
    urls = pages.select(F.col(url_col).alias("url")).unionByName(ends).filter(F.col("url").isNotNull()).distinct()
    ruled = materialize(match_rules(urls, rules), "ruled")
    classes = components(edges.select(_bare("a").alias("a"), _bare("b").alias("b")))
    member = ruled.join(classes, _bare("url") == F.col("node")).select("url", "component", "verdict")
    rank = F.when(F.col("verdict") == "allow", 2).when(F.col("verdict") == "block", 1).otherwise(0)
    decided = member.groupBy("component").agg(F.max(rank).alias("r")).filter("r > 0").select(F.col("component").alias("c"), F.when(F.col("r") == 2, "allow").otherwise("block").alias("class_verdict"))
    spread = member.join(decided, F.col("component") == F.col("c")).select(F.col("url").alias("u"), "class_verdict")
    final = ruled.join(spread, F.col("url") == F.col("u"), "left").select(F.col("url").alias("u"), "host", "path", "rule", F.coalesce("verdict", "class_verdict", F.lit(default)).alias("verdict"), "class_verdict")
    out = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url")).join(final, F.col("url") == F.col("u"), "left").drop("u")
    return out.select(id_col, "url", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), "class_verdict")

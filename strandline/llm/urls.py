"""URL filters: rules by host and path, and decisions that redirects and canonical links pass on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.graph import connected_components
from strandline.llm.text import lower_ascii
from strandline.session import written

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_CANONICAL = "(?is)<link\\b(?=[^>]*\\brel\\s*=\\s*[\"']?canonical\\b)[^>]*?\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)"
_REFRESH = "(?is)<meta\\b(?=[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b)[^>]*?\\bcontent\\s*=\\s*[\"']?[^\"'>]*?url\\s*=\\s*([^\"'\\s>]+)"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ://, up to / ? # or the end, A-Z lowered; path: from there to ? # or the end; else empty."""
    there = F.contains(url, F.lit("://"))
    after = F.substr(url, F.locate("://", url) + 3, F.length(url))
    host = F.coalesce(F.when(there, lower_ascii(F.regexp_extract(after, "^[^/?#]*", 0))), F.lit(""))
    path = F.coalesce(F.when(there, F.regexp_extract(after, "(?s)^[^/?#]*([^?#]*)", 1)), F.lit(""))
    return host, path


def _judge(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"),) * 2


def _node(host: Column, path: Column, url: Column) -> Column:
    """What names a page: host without a standard port, path without its last slash, and the query; null without a host."""
    query = F.regexp_extract(url, "^[^?#]*(\\?[^#]*)?", 1)
    return F.when(host != "", F.concat(F.regexp_replace(host, ":(80|443)$", ""), F.regexp_replace(path, "/$", ""), query))


def _absolute(link: Column, url: Column, host: Column, path: Column) -> Column:
    """A link of a page as an absolute URL."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme = F.concat(F.regexp_extract(url, "^([^:]*):", 1), F.lit(":"))
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "[^/]*$", "")
    root = F.concat(scheme, F.lit("//"), host)
    return (
        F.when(F.contains(link, F.lit("://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(root, folder, link))
    )


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of) for each row of pages (page_id, url, html).

    A rule's verdict stands: of those that fit the longest. Other pages take the verdict of their
    aliases: the component, over canonical links, page refreshes and rows of redirects (url, target),
    of URLs that lead to each other. A component with an explicitly allowed URL is allowed, else one
    with a blocked URL is blocked, else allowed. Link targets count, be they crawled or not. alias_of
    is the smallest URL of the page's component, null where it has no aliases. URLs are the same up to scheme,
    fragment, standard port and a closing slash. Null and malformed URLs have no aliases and are
    allowed; null html has no links; repeated rows repeat; further columns are ignored.
    """
    url = F.col("url")
    host, path = host_path(url)
    html = F.col("html")
    links = F.concat(
        F.when(F.contains(F.lower(html), F.lit("canonical")), F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(1))).otherwise(F.array().cast("array<string>")),
        F.when(F.contains(F.lower(html), F.lit("http-equiv")), F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(1))).otherwise(F.array().cast("array<string>")),
    )
    seen = pages.select("page_id", "url", host.alias("host"), path.alias("path"), F.coalesce(links, F.array().cast("array<string>")).alias("links"))
    seen = seen.withColumn("node", _node(F.col("host"), F.col("path"), url))
    seen = written(seen, "urls")
    rule, verdict = _judge(F.col("host"), F.col("path"), rules)
    judged = seen.select("page_id", "host", "path", "node", rule.alias("rule"), verdict.alias("own"))

    hops = seen.where((F.size("links") > 0) & F.col("node").isNotNull()).select("url", "host", "path", F.explode("links").alias("link"))
    hops = hops.select("url", _absolute(F.col("link"), F.col("url"), F.col("host"), F.col("path")).alias("target"))
    if redirects is not None:
        hops = hops.unionByName(redirects.select("url", "target"))
    ends = hops.select("url", *[c.alias(n) for n, c in zip(("h1", "p1"), host_path(url), strict=True)], "target", *[c.alias(n) for n, c in zip(("h2", "p2"), host_path(F.col("target")), strict=True)])
    ends = written(ends.select("h1", "p1", _node(F.col("h1"), F.col("p1"), url).alias("a"), "h2", "p2", _node(F.col("h2"), F.col("p2"), F.col("target")).alias("b")), "hops")
    roots = connected_components(ends)

    def told(df: DataFrame, node: str, h: str, p: str) -> DataFrame:
        return df.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), _judge(F.col(h), F.col(p), rules)[1].alias("own"))

    every = told(seen, "node", "host", "path").unionByName(told(ends, "a", "h1", "p1")).unionByName(told(ends, "b", "h2", "p2"))
    nodes = every.where(F.col("own").isNotNull()).distinct().join(roots, "node")
    decided = nodes.groupBy("root").agg(F.when(F.max(F.col("own") == "allow"), "allow").otherwise("block").alias("passed"))
    names = roots.join(decided, "root", "left").select(F.col("node").alias("_node"), "root", "passed")
    out = judged.join(names, judged.node == names["_node"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "passed", F.lit("allow")).alias("verdict"), F.col("root").alias("alias_of"))

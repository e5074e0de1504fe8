"""URL filters with redirect equivalence, on DataFrame functions alone.

Host and path rules decide first; the longest matching rule wins. Pages whose
urls are aliases of one another (a redirect, a canonical link, or the same url)
form a component. A page without a rule takes the decision of its component:
allow if a rule allows one of its members, else block if a rule blocks one, else
allow. A page's own rule always stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HUBS, connected_components, cut, joined

#: (action, host and path) pairs of the production rule set.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_COMMENT = r"(?s)<!--.*?-->"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"""(?is)(?<![\w-])rel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
_REFRESH = r"""(?is)(?<![\w-])http-equiv\s*=\s*["']?\s*refresh\b"""
#: An attribute's value in double quotes, single quotes or none.
_VALUE = r"""(?is)(?<![\w-]){}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_TARGET = r"""(?is)^\s*\d*(?:\.\d*)?\s*[;,]\s*(?:url\s*=\s*)?["']?\s*([^"'\s]+)"""
# fixed values: character references that occur in urls; that of & comes last, so nothing is decoded twice
_REFERENCES = (("quot|#34|#x22", '"'), ("apos|#39|#x27", "'"), ("lt|#60|#x3c", "<"), ("gt|#62|#x3e", ">"), ("sol|#47|#x2f", "/"), ("colon|#58|#x3a", ":"), ("quest|#63|#x3f", "?"), ("equals|#61|#x3d", "="), ("num|#35|#x23", "#"), ("amp|#38|#x26", "&"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path) that matches, else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute with character references decoded and without blanks around; empty if there is none."""
    pattern = _VALUE.format(name)
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    for names, char in _REFERENCES:
        value = F.regexp_replace(value, f"(?i)&(?:{names});", char)
    return F.trim(F.regexp_replace(value, r"[\t\r\n]", ""))


def _without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` parts are worked out."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    # the first part stands before the leading slash; a path that ends in dots names a folder
    parts = F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/")
    rest = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(rest, "/"))).otherwise(path)


def node_of(url: Column) -> Column:
    """The one spelling under which urls are aliases: scheme and host in small letters, dots worked out, no fragment; null without ``://``."""
    scheme = ascii_lower(F.regexp_extract(url, r"(?s)^\s*(.*?)://", 1))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(url), _without_dots(path_of(url)), query))


def resolved(url: Column, target: Column) -> Column:
    """The absolute url that a page's link names, relative to the page's own; null for other schemes and for the page itself."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    path = path_of(url)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None).cast("string"))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path, target))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a``, ``b``: a page's url and the one that its canonical link or refresh redirect names, both as ``node_of`` spells them."""
    html, tag = F.col(f"`{html_col}`"), F.col("tag")
    tags = F.regexp_extract_all(F.regexp_replace(html, _COMMENT, ""), F.lit(_TAG), 0)
    canonical = F.when(tag.rlike(r"(?is)^<link\b") & tag.rlike(_CANONICAL), _attribute(tag, "href"))
    refresh = F.when(tag.rlike(r"(?is)^<meta\b") & tag.rlike(_REFRESH), F.regexp_extract(_attribute(tag, "content"), _TARGET, 1))
    may = F.lower(html).rlike("canonical|refresh")
    found = pages.where(may).select(F.col(f"`{url_col}`").alias("url"), F.explode(tags).alias("tag")).select("url", F.coalesce(canonical, refresh).alias("target"))
    found = found.where("target is not null").select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("url"), F.col("target"))).alias("b"))
    return found.where("a is not null and b is not null and a <> b").distinct()


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host``, ``path``, ``rule`` and ``verdict`` for every page.

    ``redirects`` may add edges (columns ``a``, ``b`` of absolute urls). Null urls and urls
    without ``://`` have no host, no rule and no aliases: they are allowed. Repeated
    rows are judged alike. Where there is no edge only spellings of one url are aliases, and
    as rules depend on host and path alone no page then changes its rule's decision.
    """
    url = F.col(f"`{url_col}`")
    actions = F.create_map(*[F.lit(x) for action, rule in rules for x in (rule, action)])
    judged = pages.select(F.col(f"`{id_col}`").alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("own", F.element_at(actions, F.col("rule")))
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where("a <> b"))
    edges = cut(edges)
    if edges.isEmpty():
        return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    parts = cut(connected_components(edges))
    own = F.element_at(actions, rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
    decided = parts.withColumn("own", own).groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"), F.count(F.lit(1)).alias("k"))
    met = joined(parts, decided, ["component"], parts.count())
    blocked = met.where("blocked and not coalesce(allowed, false)").select("node", F.lit("block").alias("alias"))
    # many pages may have one url: their rows aren't gathered either
    named = judged.withColumn("node", node_of(F.col("url")))
    counted = named.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    found = cut(blocked.join(counted, "node"))
    limit = max(1024, pages.count() // HUBS)
    hot = F.broadcast(found.where(F.col("k") > limit).select("node", F.col("alias").alias("hot_alias")))
    out = named.join(hot, "node", "left").join(found.where(F.col("k") <= limit).select("node", "alias"), "node", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("own", "hot_alias", "alias", F.lit("allow")).alias("verdict"))

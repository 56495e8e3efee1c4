"""URL filters: host and path rules, carried over redirects and canonical links.

A rule such as ``example.com/en/`` fits its host and every subdomain where
the path starts with the rule's; the longest fitting rule decides.  Pages
that no rule fits take the decision of their aliases: URLs joined by
redirects and canonical links, which distributed connected components
gather.  An allowed alias outweighs any blocked one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import store

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAGS = r"(?is)(<link\b[^>]*>|<meta\b[^>]*>)"
_CANONICAL = r"""(?is)\brel\s*=\s*["']?\s*canonical\b"""
_REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_TARGET = r"""(?is)\burl\s*=\s*['"]?([^'">\s;]+)"""


@dataclass(frozen=True)
class Rule:
    """verdict is allow or block; text is a host and the start of a path, like ``example.com/en/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without one or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' as for the host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits; null without one."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(r.text)).otherwise(found)
    return found


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, its segments ``.`` and ``..`` taken out as RFC 3986, 5.2.4 does."""
    parts = F.split(path, "/")
    parts = F.slice(parts, 2, F.size(parts))
    left = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    ends_open = F.element_at(parts, -1).isin(".", "..") & (F.size(left) > 0)
    joined = F.concat(F.lit("/"), F.array_join(left, "/"), F.when(ends_open, F.lit("/")).otherwise(F.lit("")))
    return F.when(path.contains("/."), joined).otherwise(path)


def node_of(url: Column) -> Column:
    """A URL's key among aliases: host in lower case, path without dots, query; neither scheme nor fragment; null without a host."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(without_dots(path)), query))


def _unescape(text: Column) -> Column:
    """Character references that URLs in attributes are written with."""
    for name, char in (("&quot;|&#34;|&#x22;", '"'), ("&apos;|&#39;|&#x27;", "'"), ("&lt;|&#60;|&#x3c;", "<"), ("&gt;|&#62;|&#x3e;", ">"), ("&amp;|&#38;|&#x26;", "&")):
        text = F.regexp_replace(text, f"(?i){name}", char)
    return text


def resolve(target: Column, url: Column) -> Column:
    """A link target as an absolute URL, by RFC 3986, 5.2; null if it is empty or has another scheme without a host, like mailto."""
    scheme = F.regexp_extract(target, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    rest = F.when(scheme == "", target).otherwise(F.substr(target, F.length(scheme) + 2))
    path = F.regexp_extract(rest, r"(?s)^(?://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?#]*(\?[^#]*)", 1)
    base_scheme, base_path = F.regexp_extract(url, r"(?s)^(.*?)://", 1), path_of(url)
    base_path = F.when(base_path == "", F.lit("/")).otherwise(base_path)
    base_query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    root = F.concat(base_scheme, F.lit("://"), host_of(url))
    return (
        F.when(target == "", None)
        .when(scheme != "", F.when(rest.startswith("//"), target))
        .when(rest.startswith("//"), F.concat(base_scheme, F.lit(":"), rest))
        .when(path == "", F.concat(root, base_path, F.when(query == "", base_query).otherwise(query)))
        .when(path.startswith("/"), F.concat(root, without_dots(path), query))
        .otherwise(F.concat(root, without_dots(F.concat(F.regexp_extract(base_path, r"(?s)^(.*/)", 1), path)), query))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v) edges from each page's URL to its canonical link and its redirect (meta refresh) target.

    Pages without URL, HTML or such a link give none; repeated rows repeat
    their edges.
    """
    tags = F.regexp_extract_all("html", F.lit(_TAGS), 1)
    tag = pages.where(F.col("url").contains("://") & F.col("html").rlike(f"{_CANONICAL}|{_REFRESH}")).select("url", F.explode(tags).alias("tag"))
    href = F.concat(*[F.regexp_extract("tag", _HREF, i) for i in (1, 2, 3)])
    target = F.when(F.col("tag").rlike(_CANONICAL), href).when(F.col("tag").rlike(_REFRESH), F.regexp_extract("tag", _TARGET, 1))
    return tag.select(node_of(F.col("url")).alias("u"), node_of(resolve(F.trim(_unescape(target)), F.col("url"))).alias("v")).where("u is not null and v is not null")


def judge(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url, html).

    verdict is the rule's, where one fits.  Else it is allow if any alias
    is allowed by a rule, block if any is blocked, and allow otherwise.
    edges adds (u, v) pairs of URLs known to redirect to each other.  Rows
    that repeat a page_id are judged each; a null URL fits no rule and is
    allowed; an empty table gives an empty result.
    """
    verdict_of = F.coalesce(*[F.when(F.col("rule") == r.text, F.lit(r.verdict)) for r in rules], F.lit(None).cast("string"))
    url = F.col("url")
    linked = alias_edges(pages)
    if edges is not None:
        linked = linked.unionByName(edges.select(node_of(F.col("u")).alias("u"), node_of(F.col("v")).alias("v")).where("u is not null and v is not null"))
    groups = connected_components(linked)
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node")).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))

    # A node of a component may be a URL that no page has; rules judge it too.
    named = groups.select("component", "node", F.concat(F.lit("http://"), "node").alias("url"))
    known = named.select("component", rule_for(host_of(F.col("url")), path_of(F.col("url")), rules).alias("rule")).where("rule is not null")
    ruled = store(known.select("component", verdict_of.alias("verdict")).groupBy("component").agg(F.min("verdict").alias("alias_verdict")))  # allow sorts first
    aliases = groups.join(ruled, "component").select("node", "alias_verdict")
    return own.join(aliases, "node", "left").select("page_id", "host", "path", "rule", F.coalesce(verdict_of, "alias_verdict", F.lit("allow")).alias("verdict"))

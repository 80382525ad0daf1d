"""URL filter: block decisions reach the aliases of a page over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.functions.urls import resolve_url
from moodspark.llm.common import lower_az, small_enough, stage, table
from moodspark.llm.components import components
from moodspark.sources.pages import _decode

#: (host, path, verdict) of op8, as its contract lists them.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    return F.coalesce(lower_az(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); of equal ones the first allow."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r[0], r[1]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in reversed(order):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_key(url: Column) -> Column:
    """What stands for a url in the graph: without fragment, scheme and host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    start = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(lower_az(start), F.substr(bare, F.length(start) + 1))


_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh\b[^>]*>"


def _attribute(tag: Column, name: str) -> Column:
    """The attribute's value in a tag, quoted or not, with character references decoded."""
    pattern = rf"(?is)(?<![\w-]){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))
    return F.trim(F.when(value.contains("&"), _decode(value)).otherwise(value))


def page_links(pages: DataFrame) -> DataFrame:
    """url, target: all canonical links and redirects that the pages' html states.

    Character references are decoded and relative targets resolved against the page's url.
    """
    some = pages.where("url IS NOT NULL AND html IS NOT NULL")
    tags = some.select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))).alias("tag"))
    canonical = tags.select("url", _attribute(F.col("tag"), "href").alias("link"))
    tags = some.select("url", F.explode(F.regexp_extract_all("html", F.lit(_REFRESH), F.lit(0))).alias("tag"))
    content = tags.select("url", _attribute(F.col("tag"), "content").alias("content"))
    to = F.regexp_extract("content", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    found = canonical.unionByName(content.select("url", to.alias("link"))).where("link <> ''")
    return found.select("url", resolve_url(F.trim("url"), F.col("link")).alias("target")).distinct()


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule, verdict, component_id of every page's url.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins,
    and its verdict is the page's.  Other pages take the verdict of their aliases: urls connected by
    canonical links, by redirects that the html states, or by the rows (url, target) of `redirects`.
    If a rule allows one of the aliases, the page is allowed; else if a rule blocks one, it is blocked;
    else it has the default.  So an explicit allow always goes before a block that was handed on.

    Aliases join by a hash of the url without fragment; component_id is the least one, null for urls
    without an alias.  A url that very many pages have is one node: pages meet nodes after being reduced to
    distinct urls, and a component's verdict is a pair of flags, combined before the shuffle.

    A null url or one without :// has empty host and path, no rule and no alias.  Repeated rows are all
    returned.  Columns other than page_id, url and html are not read; html may be absent.
    """
    if "html" not in pages.columns:
        pages = pages.withColumn("html", F.lit(None).cast("string"))
    parsed = pages.select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumn("_rule", _rule(F.col("host"), F.col("path"), rules))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    node = lambda c: F.when(F.col(c).contains("://"), F.xxhash64(url_key(F.col(c))))
    # written before nodes are made: a filter on nodes would be moved below and repeat the targets' expressions in itself
    links = stage(links, "links").select("url", "target", node("url").alias("a"), node("target").alias("b")).where("a <> b")
    same = stage(components(links), "aliases")
    # the verdicts of a component: those of its pages and of link ends that are no page
    ends = links.select("url").union(links.select("target")).distinct()
    ruled = ends.select(
        node("url").alias("node"), _rule(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("verdict")
    ).where("verdict IS NOT NULL")
    told = ruled.join(same, "node").groupBy("component").agg(
        F.max(F.col("verdict") == "allow").alias("allow"), F.max(F.col("verdict") == "block").alias("block")
    )
    handed = same.join(told, "component", "left").select(
        F.col("node").alias("_node"), F.col("component").alias("component_id"), "allow", "block"
    )
    handed = small_enough(stage(handed, "handed"))
    out = parsed.withColumn("_node", node("url")).join(handed, "_node", "left")
    verdict = F.coalesce(
        F.col("_rule.verdict"),
        F.when(F.col("allow"), "allow").when(F.col("block"), "block"),
        F.lit(default),
    )
    return out.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "component_id"
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")

"""URL filters with redirect equivalence.

Rules block or allow hosts with their subdomains, below a path. Redirects and
canonical links say that two addresses are the same page: within a connected
component of such links, one blocked address blocks all that no rule allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.components import connected_components
from labelweave.llm.steps import join_sized, saved

BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(text: str, verdict: str) -> Rule:
    """``host/path`` with a verdict; the path begins with the first slash."""
    host, slash, path = text.partition("/")
    return Rule(host, slash + path, verdict)


RULES = (
    rule("net/", BLOCK),
    rule("example.net/en/", ALLOW),
    rule("example.com/de/", BLOCK),
    rule("org/fr/", ALLOW),
)

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
LINK = r"(?is)<link\b[^>]*>"
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)="
META = r"(?is)<meta\b[^>]*>"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lowered; else empty."""
    raw = F.coalesce(F.regexp_extract(url, HOST, 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """(rule_host, rule_path, rule, decides): a block list as a table, of any length."""
    return spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "rule_host string, rule_path string, rule string, decides string")


def fitting(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, decides) of the distinct (host, path) of ``addresses`` that a rule fits.

    Every host is joined by its suffixes, so the work does not grow with the
    number of rules; of the rules whose path begins the address's path the
    longest decides, of equally long ones the first in order of text.
    """
    rows = addresses.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = rows.withColumn("rule_host", F.explode(F.array_distinct(suffixes)))
    fits = join_sized(spread, rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    best = F.min(F.struct(-F.length("rule"), "rule", "decides")).alias("best")
    return fits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.decides")


def node_of(url: Column) -> Column:
    """The address a URL asks a server for: without the part behind ``#``; null stays null."""
    return F.regexp_replace(url, r"(?s)#.*$", "")


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    return F.regexp_replace(quoted, r"(?is)^[\w-]+\s*=\s*|[\"']", "")


def declared_links(pages: DataFrame) -> DataFrame:
    """(a, b) addresses that pages declare the same: canonical links and refresh redirects in their HTML.

    Only absolute targets (with ``://``) count.
    """
    tags = pages.filter(F.col("url").isNotNull() & F.col("html").isNotNull())
    tags = tags.filter(F.col("html").rlike(r"(?is)rel\s*=\s*[\"']?canonical|http-equiv\s*=\s*[\"']?refresh"))
    links = tags.select("url", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(0))).alias("tag"))
    links = links.filter(F.lower(_attribute(F.col("tag"), "rel")) == "canonical")
    canonical = links.select("url", _attribute(F.col("tag"), "href").alias("to"))
    metas = tags.select("url", F.explode(F.regexp_extract_all("html", F.lit(META), F.lit(0))).alias("tag"))
    metas = metas.filter(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh")
    content = F.regexp_extract("tag", r"(?is)\burl\s*=\s*['\"]?([^'\">\s]+)", 1)
    both = canonical.unionByName(metas.select("url", content.alias("to")))
    both = both.filter(F.col("to").contains("://"))
    return both.select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b"))


def plain_address(url: Column) -> Column:
    """The address that variants of an http URL share; null for anything else.

    Written alike: https, the host lowered and without ``www.`` and default
    ports, no slashes at the end of the path, no tracking parameters, no part
    behind ``#``. Other parameters stay in their order.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), ":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(node_of(url), r"(?s)^[^?]*\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    plain = F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(url.rlike("(?i)^https?://"), plain)


def variant_links(pages: DataFrame) -> DataFrame:
    """(a, b): the addresses of pages and the plain address their variants share."""
    links = pages.select(node_of(F.col("url")).alias("a"), plain_address(F.col("url")).alias("b"))
    return links.filter("b is not null and a <> b").distinct()


def judge(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of) for every row of ``pages``.

    Links are those that pages declare, and those from every http address to the
    plain one its variants share; ``redirects`` may add pairs (a, b) of URLs.
    ``rules`` may also be a table as ``rule_table`` makes it. A page's own longest rule decides. Without one, the page is blocked if its
    component holds an address that a rule blocks, and allowed otherwise; an
    allow rule is never overridden, and says nothing about other addresses.
    alias_of is the least address of the component, null where there are no
    links. Null URLs and URLs without ``://`` have an empty host and path.
    Repeated rows repeat; other columns are ignored; an empty table gives no rows.
    """
    edges = declared_links(pages).unionByName(variant_links(pages))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")))
    listed = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    joined = saved(connected_components(saved(edges, "url-edges")), "url-components")
    # Addresses that take part in links, pages or not, and pages that do not.
    nodes = joined.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    found = saved(fitting(rows.select("host", "path").union(nodes.select("host", "path")), listed), "url-rules")
    bad = nodes.join(found.filter(F.col("decides") == BLOCK), ["host", "path"]).select("component").distinct()
    known = joined.join(bad.withColumn("bad", F.lit(True)), "component", "left")
    out = rows.join(found, ["host", "path"], "left").withColumn("node", node_of(F.col("url"))).join(known, "node", "left")
    verdict = F.coalesce("decides", F.when(F.col("bad"), BLOCK).otherwise(ALLOW))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("component").alias("alias_of"))

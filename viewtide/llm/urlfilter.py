"""URL verdicts by rules, spread over redirect equivalence. DataFrame operations only.

Rules name a host (with its subdomains) and a path prefix; the longest that fits decides.
A URL no rule fits takes the decision of its equivalents: URLs connected through canonical
links, redirects, or a common canonical form. Within such a component an explicit allow
wins over any block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewtide.llm.graph import connected_components
from viewtide.llm.scratch import keep

#: Query parameters that do not name another document.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")


def host_of(url: Column) -> Column:
    """Lower-cased text after the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The form equivalent URLs share: no scheme, fragment, tracking parameter, final slash
    or index page. Null for what is no absolute URL."""
    path = F.regexp_replace(path_of(url), r"(?:/(?:index\.html?)?)$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.concat_ws("&", kept))).otherwise("")
    return F.when(host_of(url) != "", F.concat(host_of(url), path, tail))


def _resolved(base: Column, link: Column) -> Column:
    """An absolute URL for a link found on the page ``base``."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*/)", 1)
    return (F.when(link == "", None)
            .when(link.contains("://"), link)
            .when(link.startswith("//"), F.concat(F.lit("http:"), link))
            .when(link.startswith("/"), F.concat(root, link))
            .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(root, F.lit("/"))), link)))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a, b, host, path``: canonical forms of pages and of their canonical links and meta
    refreshes, and the link's own host and path."""
    text = F.coalesce(F.col(html), F.lit(""))
    tags = F.regexp_extract_all(text, F.lit(r"(?i)(<(?:link|meta)\s[^>]*>)"), F.lit(1))
    links = F.transform(F.filter(tags, lambda t: t.rlike(r"""(?i)\srel\s*=\s*["']?canonical\b""")),
                        lambda t: F.regexp_extract(t, r"""(?i)\shref\s*=\s*["']?([^"'\s>]*)""", 1))
    moves = F.transform(F.filter(tags, lambda t: t.rlike(r"""(?i)\shttp-equiv\s*=\s*["']?refresh\b""")),
                        lambda t: F.regexp_extract(t, r"""(?i)url\s*=\s*["']?([^"'\s>]*)""", 1))
    found = pages.select(F.col(url).alias("u"), F.explode(F.concat(links, moves)).alias("link"))
    return _pairs(found.select("u", _resolved(F.col("u"), F.col("link")).alias("v")), "u", "v")


def _pairs(urls: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, host, path``: canonical forms of two URLs, host and path of the second."""
    to = F.col(b)
    return urls.select(canonical(F.col(a)).alias("a"), canonical(to).alias("b"), host_of(to).alias("host"),
                       path_of(to).alias("path"))


def rule_hits(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict``: the longest rule for each distinct host and path.

    A rule fits a host if it is one of the host's suffixes at a dot. Rules that fit equally
    long are told apart by verdict: allow before block."""
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(
        ".", F.slice(labels, i, F.size(labels)))))
    offered = parts.select("host", "path", suffix.alias("rule_host"))
    fits = offered.join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        F.length(rule).alias("size"), (F.col("rule_verdict") == "allow").alias("allows"), rule.alias("rule"),
        F.col("rule_verdict").alias("verdict"))).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def url_filter(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, url: str = "url",
               html: str = "html", carry: list[str] | None = None, default: str = "allow") -> DataFrame:
    """The ``carry`` columns of ``pages`` (all by default) plus ``host, path, rule, verdict``.

    ``rules`` has ``rule_host, rule_path, rule_verdict``. ``edges`` may add known redirects
    as URLs ``a, b``. A page that no rule fits is blocked if its component holds a URL
    that a rule blocks and none that a rule allows; otherwise it gets ``default``. Rules
    judge every URL of a component: targets of links and both ends of ``edges`` too, whether
    they are pages or not. Pages of one canonical form are one node, so a URL repeated on
    any share of the rows costs one row per task in the shuffle.

    A null url, or one without ``://``, has empty host and path, no rule and no equivalents.
    Null html has no links. One row in, one row out; repeated rows get equal answers.
    Columns of ``pages`` named like a result (in any case) are replaced.
    """
    results = ("host", "path", "rule", "verdict")
    columns = [c for c in carry or pages.columns if c.lower() not in results]
    address = F.col(url)
    rows = pages.select(*columns, host_of(address).alias("host"), path_of(address).alias("path"),
                        canonical(address).alias("__node"))
    links = page_links(pages, url, html)
    if edges is not None:
        links = links.unionByName(_pairs(edges, "a", "b")).unionByName(_pairs(edges, "b", "a"))
    # Both ends are judged: a page is a row, the other end need not be one.
    links = keep(links.filter("b IS NOT NULL").distinct(), "links")
    ends = links.select(F.col("b").alias("__node"), "host", "path")
    nodes = rows.filter("__node IS NOT NULL").select("__node", "host", "path").unionByName(ends).distinct()
    parts = rows.select("host", "path").unionByName(ends.select("host", "path")).distinct()
    hits = keep(rule_hits(parts, rules), "rules")
    links = links.filter("a <> b").select("a", "b").distinct()

    decided = nodes.join(hits, ["host", "path"]).groupBy("__node").agg(
        F.max((F.col("verdict") == "allow")).alias("allows"), F.max((F.col("verdict") == "block")).alias("blocks"))
    if not links.isEmpty():
        roots = connected_components(links).withColumnsRenamed({"node": "__node"})
        of_root = decided.join(roots, "__node", "left").withColumn("root", F.coalesce("root", "__node")).groupBy("root").agg(
            F.max("allows").alias("allows"), F.max("blocks").alias("blocks"))
        every = nodes.select("__node").distinct().join(roots, "__node", "left").withColumn(
            "root", F.coalesce("root", "__node"))
        decided = every.join(of_root, "root").select("__node", "allows", "blocks")
    blocked = decided.filter("blocks AND NOT allows").select("__node", F.lit("block").alias("__spread"))
    out = rows.join(hits, ["host", "path"], "left").join(blocked, "__node", "left")
    return out.select(*columns, "host", "path", "rule",
                      F.coalesce("verdict", "__spread", F.lit(default)).alias("verdict"))

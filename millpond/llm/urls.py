"""Redirect equivalence (operator 3): block decisions reach every alias of a url, explicit allow rules come first.

Urls are nodes. An edge joins a page's url with

- its canonical form: scheme and fragment dropped, host in lower case without a default port, tracking parameters and a
  trailing slash of the path taken off;
- the target of a canonical link in its html, `<link rel="canonical" href="...">`;
- the target of a redirect in its html, `<meta http-equiv="refresh" content="0; url=...">`;
- the target of a row of an optional table of redirects (`source`, `target`).

The connected components of these edges are classes of aliases. A url with a rule keeps the rule's verdict. A url without one
takes its class's: allow if a member is allowed by a rule (an explicit allow precedes a propagated block), else block if
a member is blocked, else allow. Targets need not be pages: their urls are judged by the rules and count as members.

Rules are a fixed short list, applied as expressions; the longest fitting rule wins. Nothing but joins, grouping and
built-in functions is used; a class that holds a third of all pages is never gathered in one place.

A null url, or one without `://`, has an empty host and path, no rule and no aliases, and is allowed. Repeated rows are judged
alike. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """The host, ASCII letters in lower case; empty without `://`."""
    return F.translate(F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a query or fragment."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest fitting rule as a struct of `rule` and `verdict`; null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def canonical(url: Column) -> Column:
    """The canonical form that aliases of one address share; null without a host."""
    host = F.regexp_replace(host_of(url), ":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(_after_scheme(url), "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_join(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(f"^({TRACKING})(=.*)?$"))), "&"
    )
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def resolve(base: Column, target: Column) -> Column:
    """A link's target as a full url; null for a null or empty one."""
    scheme = F.substring_index(base, "://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    link = F.trim(target)
    return (
        F.when(link.isNull() | (link == ""), None)
        .when(F.regexp_like(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def _links(html: Column) -> Column:
    """The targets of a page's canonical links and redirects. Tags end at the next `<` or `>`, so no scan is repeated."""
    tags = F.regexp_extract_all(html, F.lit("(?i)(<(?:link|meta)\\s[^<>]*+>)"), 1)
    wanted = F.filter(tags, lambda t: F.regexp_like(t, F.lit("(?i)rel\\s*=\\s*[\"']?canonical|http-equiv\\s*=\\s*[\"']?refresh")))
    target = "(?i)(?:href\\s*=\\s*[\"']?|;\\s*url\\s*=\\s*['\"]?)([^\\s\"'>]+)"
    return F.transform(wanted, lambda t: F.regexp_extract(t, target, 1))


def edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """All links `a`-`b` between canonical forms, with the full urls they came from (`url`), one row per member url."""
    own = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).where("url is not null")
    linked = own.select("url", F.explode(_links(F.col("html"))).alias("target")).select("url", resolve(F.col("url"), F.col("target")).alias("target"))
    if redirects is not None:
        linked = linked.union(redirects.select(F.col("source").cast("string"), F.col("target").cast("string")))
    return linked.where("target is not null").select(
        canonical(F.col("url")).alias("a"), canonical(F.col("target")).alias("b"), F.col("url"), F.col("target")
    )


def judge(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: `page_id`, `host`, `path`, `rule`, `verdict`, and `alias_class`, the smallest canonical form."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = own.select("page_id", "url", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("node"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path")))

    links = cut(edges(pages, redirects), "aliases")
    classes = components(links.select("a", "b"), "aliases")
    members = judged.select("node", F.col("rule.verdict").alias("verdict")).union(
        links.select(F.explode(F.array("url", "target")).alias("url")).select(
            canonical(F.col("url")), rule_of(host_of(F.col("url")), path_of(F.col("url")))["verdict"]
        )
    )
    # First one row per node, then per class: a node or class of very many pages is reduced before each shuffle.
    ruled = members.where("node is not null").groupBy("node").agg(
        F.bool_or(F.coalesce(F.col("verdict") == "allow", F.lit(False))).alias("allowed"),
        F.bool_or(F.coalesce(F.col("verdict") == "block", F.lit(False))).alias("blocked"),
    )
    named = ruled.join(classes, "node", "left").withColumn("alias_class", F.coalesce("component", "node"))
    whole = named.groupBy("alias_class").agg(F.bool_or("allowed").alias("allowed"), F.bool_or("blocked").alias("blocked"))
    verdicts = named.select("node", "alias_class").join(whole, "alias_class")
    spread = F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow")
    return judged.join(verdicts, "node", "left").select(
        "page_id", "host", "path", F.col("rule.rule").alias("rule"),
        F.coalesce(F.col("rule.verdict"), spread).alias("verdict"), "alias_class",
    )

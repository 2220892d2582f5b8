"""URL decisions that carry over redirects and canonical links.

Rules decide for the addresses that they fit. Addresses joined by redirect or canonical-link edges are one resource:
its connected component passes a block on to aliases without a rule of their own, unless some address in it is
explicitly allowed. Components are found by distributed star rounds, and only addresses in a link take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import join_unique
from millrace.llm.components import connected_components

#: (host, path, action)
Rule = tuple[str, str, str]
#: Literal rules are compared one by one with each address up to this many; more are joined by host.
FEW_RULES = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, its `.` and `..` segments worked off."""
    ended = F.when(path.rlike(r"/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path)
    back = lambda p: F.regexp_replace(p, "(?s)/[^/]*$", "")
    return F.aggregate(F.slice(F.split(ended, "/", -1), 2, F.length(ended) + 1), F.lit(""), lambda p, x: F.when(x == ".", p).when(x == "..", back(p)).otherwise(F.concat(p, F.lit("/"), x)))


def resolved(link: Column, base: Column) -> Column:
    """The whole address of a link on the page at base: `//host/x`, `/x`, `x`, `../x` and `?q` are taken from there.

    Null for a link to a place in the page itself, one of a kind without a host (`mailto:`), and a relative one on a page without `://`.
    """
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    root, own = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), path_of(base)
    folder = F.regexp_extract(own, r"(?s)^(.*/)", 1)
    whole = F.when(path == "", own).when(F.startswith(path, F.lit("/")), without_dots(path)).otherwise(without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), path)))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:|#|$)") | (root == ""), None)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "(?s)^(.*?:)//", 1), link)).otherwise(F.concat(root, whole, rest))
    )


def canonical_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v) from each page's address to its canonical link and to where a meta refresh sends it, relative ones resolved.

    Attributes may come in any order and case, quoted or not. Pages without either are dropped by a substring test.
    """
    tags = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)(<(?:link|meta)\b[^>]*\b(?:canonical|refresh)\b[^>]*>)"), F.lit(1))
    link = F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?\s*([^\s\"'>]+)", 1)
    refresh = F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?\s*([^\s\"'>]+)", 1)
    is_link = F.col("tag").rlike(r"(?is)^<link\b.*\srel\s*=\s*(?:\"[^\">]*\bcanonical\b|'[^'>]*\bcanonical\b|[^\s\"'>]*\bcanonical\b)")
    is_refresh = F.col("tag").rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b")
    found = pages.filter(F.col(html_col).rlike("(?i)canonical|refresh")).select(F.col(url_col).alias("u"), F.explode(tags).alias("tag"))
    to = F.when(is_link, link).when(is_refresh, refresh)
    return found.select("u", resolved(F.replace(to, F.lit("&amp;"), F.lit("&")), F.col("u")).alias("v")).filter(F.col("v").contains("://"))


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def with_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """urls (with host and path) and rule, a struct (text, action) of the longest fitting rule, or null.

    Ties go to the longer host, then to allow. More than FEW_RULES rules are joined on the host and each parent domain,
    so no address meets a rule of another domain.
    """
    spark = urls.sparkSession
    kind = "struct<size:int,host_size:int,allow:boolean,text:string,action:string>"
    if len(rules) <= FEW_RULES:
        best = F.lit(None).cast(kind)
        for host, path, action in rules:
            mine = F.struct(F.lit(len(host + path)).alias("size"), F.lit(len(host)).alias("host_size"), F.lit(action == "allow").alias("allow"), F.lit(host + path).alias("text"), F.lit(action).alias("action"))
            best = F.greatest(best, F.when(_fits(F.col("host"), F.col("path"), F.lit(host), F.lit(path)), mine))
        return urls.withColumn("rule", best)
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, action string")
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    addresses = urls.select("host", "path").distinct()
    hits = addresses.withColumn("rule_host", F.explode(parents)).join(table, "rule_host").filter(F.startswith("path", F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("size"), F.length("rule_host").alias("host_size"), (F.col("action") == "allow").alias("allow"), text.alias("text"), "action")).alias("rule"))
    return urls.join(best, ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    edges: (u, v) pairs of whole addresses that redirect or canonical links join; none where it is None. The verdict is
    the rule's own if one fits. Otherwise it is block if the address's component holds a blocked address and no
    explicitly allowed one, else allow. Addresses only seen in edges are judged by the rules too and pass decisions on.
    A null address, or one without `://`, has empty host and path, fits no rule and is allowed unless linked. Repeated
    rows give a row each; an empty table gives none; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    judged = with_rules(rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules)
    if edges is not None:
        parts = connected_components(edges)
        linked = with_rules(parts.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
        acts = linked.groupBy("component").agg(F.bool_or(F.col("rule.action") == "block").alias("blocked"), F.bool_or(F.col("rule.action") == "allow").alias("allowed"))
        bad = acts.filter("blocked and not allowed").select("component")
        aliases = parts.join(bad, "component", "left_semi").select(F.col("node").alias("url"), F.lit(True).alias("alias"))
        # an address may be that of most pages, and so may none
        uses = judged.filter("url is not null").groupBy("url").agg(F.count("*").alias("n"))
        unnamed = judged.filter("url is null").withColumn("alias", F.lit(None).cast("boolean"))
        judged = join_unique(judged.filter("url is not null"), aliases.join(uses, "url"), ["url"], how="left").unionByName(unnamed)
    else:
        judged = judged.withColumn("alias", F.lit(None).cast("boolean"))
    verdict = F.coalesce("rule.action", F.when(F.col("alias"), "block"), F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("rule.text").alias("rule"), verdict.alias("verdict"))

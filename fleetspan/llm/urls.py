"""URL filters: rules by host and path, and block decisions carried over to aliases.

Two urls are aliases if a redirect or a canonical link leads from one to the other. Aliases form
components; a url without a rule of its own is blocked if some alias of it has a block rule. A
rule of the url's own, allow or block, always comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.llm.common import ascii_lower, literal_rows, small_enough
from fleetspan.llm.components import connected_components
from fleetspan.session import ensure_checkpoint_dir

# Verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def alias_key(url: Column) -> Column:
    """A url without scheme and fragment, host lower-cased; null without ``://``."""
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), F.regexp_extract(url, _URL, 3)))


def own_rules(urls: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """``urls`` has key, host, path. Returns key, rule, rule_verdict for those that a rule fits.

    A rule fits its host and all subdomains if the path starts with its path; the longest wins, of
    equally long ones the smaller text, of a text with both verdicts allow.
    """
    rule = F.concat("rule_host", "rule_path")
    wanted = rules.select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).distinct()
    if small_enough(wanted, F.length(rule)):
        wanted = F.broadcast(wanted)
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = urls.select(key, "path", F.explode(ends).alias("rule_host")).join(wanted, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy(key).agg(F.min(F.struct((-F.length(rule)).alias("size"), rule.alias("rule"), "verdict")).alias("best"))
    return best.select(key, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def page_edges(pages: DataFrame) -> DataFrame:
    """a, b: alias keys of a page and of what its canonical link or meta refresh names.

    Targets may be absolute, start with ``//`` or ``/``, or be relative to the page's folder.
    """
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    target = F.coalesce(
        F.when(F.col("tag").rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)),
        F.when(F.col("tag").rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)),
    )
    hinted = pages.where(F.col("html").rlike(r"(?i)\b(?:canonical|refresh)\b") & F.col("url").contains("://"))
    found = hinted.select("url", F.explode(tags).alias("tag")).select("url", target.alias("target")).where("target <> ''")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    full = (
        F.when(F.col("target").contains("://"), F.col("target"))
        .when(F.col("target").startswith("//"), F.concat(F.lit("http:"), "target"))
        .when(F.col("target").startswith("/"), F.concat(F.lit("http://"), host, "target"))
        .otherwise(F.concat(F.lit("http://"), host, F.regexp_extract(path, r"(?s)^(.*/)?", 0), "target"))
    )
    return found.select(alias_key(F.col("url")).alias("a"), alias_key(full).alias("b"))


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, alias (smallest alias key, null without aliases).

    ``redirects`` (from_url, to_url) adds links beyond those in the pages. Null urls and urls
    without ``://`` have empty host and path, fit no rule, have no aliases and are allowed. Every
    row of ``pages`` returns, repeated ids and urls included; pages may share a url, and a null
    html has no links. No rules: all allowed. Other columns are not read.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(alias_key(F.col("from_url")).alias("a"), alias_key(F.col("to_url")).alias("b")))
    groups = connected_components(edges)
    nodes = groups.withColumns({"host": host_of(F.concat(F.lit("http://"), "node")), "path": path_of(F.concat(F.lit("http://"), "node"))})
    blocked = nodes.join(own_rules(nodes, "node", rules), "node").groupBy("component").agg(
        F.bool_or(F.col("rule_verdict") == "block").alias("any_block")
    )
    aliases = groups.join(blocked, "component", "left").select("node", "component", F.coalesce("any_block", F.lit(False)).alias("any_block"))
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = judged.select("host", "path").distinct().withColumn("place", F.struct("host", "path"))
    rules_of = own_rules(places, "place", rules).select(F.col("place.host").alias("h"), F.col("place.path").alias("p"), "rule", "rule_verdict")
    out = judged.join(rules_of, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    out = out.withColumn("key", alias_key(F.col("url"))).join(aliases, F.col("key") == F.col("node"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("any_block"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("component").alias("alias"))


def default_rules(spark) -> DataFrame:
    return literal_rows(spark, RULES, ["verdict", "host", "path"])

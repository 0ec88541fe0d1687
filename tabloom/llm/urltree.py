"""URL filtering by a path-template tree per host, with labelled purity.

Every url is split into host and path. Urls that a rule fits are judged by the longest such rule and, being
judged, are the labelled examples from which the rest is learnt:

1. The tree. From the host downwards, level by level, a node's children are the path's next segments. Where
   children are many and none of them holds much (their urls spread as if over more than `many` equal ones, whatever
   the number of urls), the segment is variable and becomes a wildcard. A path that has a node to itself ends there: the
   rest of its segments is one child, so the tree is as deep as paths share segments, and every segment is in it.
2. Statistics. Each node counts its urls, and its labelled and blocked ones.
3. Merging. A child whose blocked share cannot be told from its siblings' pooled share (two-proportion
   z-test) is merged into one branch with all such siblings; the others stay on their own.
4. Verdict. Purity is the blocked share of a template's labelled urls, smoothed towards its parent's, and the
   root's towards 0. A template is rejected at `purity` or above.

All statistics are aggregates keyed by (host, template); a third of all urls may share a host, so counts are
partial sums before any shuffle, and the tables joined back are joined by key with Spark's skew handling.

Defined cases: null url, or no "://": host and path are empty, no rule fits; repeated rows count each; an
empty table gives an empty result; further columns are ignored; empty segments are no level.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scratch import settle


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"),
)

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Stands for any segment, and for the merged siblings; no path segment holds a slash.
WILD, MERGED = "/*", "/~"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)
    # a host that ends at ? or # has no path: what follows starts with that sign
    return F.coalesce(F.translate(host, *_LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule's name, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def templates(urls: DataFrame, many: int = 8) -> DataFrame:
    """Distinct (host, path, n, labelled, blocked) -> the same rows with `trail`, the templates from root to leaf."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = settle(urls.withColumn("segments", segments).withColumn("trail", F.array(F.lit(""))), "url-segments")
    done, level = [rows.where(F.size("segments") == 0)], 0
    rows = rows.where(F.size("segments") > 0)
    exact = "decimal(38,0)"
    while rows.limit(1).count():
        child = F.element_at("segments", level + 1)
        nodes = (rows.groupBy("host", F.element_at("trail", -1).alias("node"), child.alias("child"))
                 .agg(F.sum("n").alias("n"), F.count("*").alias("paths")).groupBy("host", "node")
                 .agg(F.count("*").alias("children"), F.sum("paths").alias("paths"), F.sum("n").cast(exact).alias("urls"),
                      F.sum((F.col("n").cast("decimal(18,0)") * F.col("n").cast("decimal(18,0)")).cast(exact)).alias("squares")))
        # the number of equal children that would be spread as evenly is urls^2 / squares
        even = F.col("urls").cast("double") * F.col("urls").cast("double") > many * F.col("squares").cast("double")
        marked = nodes.select("host", "node", ((F.col("children") > many) & even).alias("variable"), (F.col("paths") == 1).alias("alone"))
        last = F.element_at("trail", -1)
        rest = F.concat(last, F.lit("/"), F.array_join(F.slice("segments", level + 1, F.size("segments")), "/"))
        below = F.when(F.col("alone"), rest).when(F.col("variable"), F.concat(last, F.lit(WILD))).otherwise(F.concat(last, F.lit("/"), child))
        level += 1
        rows = settle(rows.withColumn("node", last).join(marked, ["host", "node"]).withColumn("trail", F.concat("trail", F.array(below)))
                      .withColumn("over", F.col("alone") | (F.size("segments") <= level)).drop("node", "variable", "alone"), "url-templates")
        done.append(rows.where("over").drop("over"))
        rows = rows.where(~F.col("over")).drop("over")
    return reduce(DataFrame.unionByName, done)


def purities(tree: DataFrame, smoothing: float = 4.0, z: float = 2.58) -> tuple[DataFrame, int]:
    """Per (host, template): its smoothed purity, after merging similar siblings; and the tree's depth."""
    counted = settle(
        tree.select("host", "n", "labelled", "blocked", "trail", F.posexplode("trail").alias("depth", "node"))
        .withColumn("parent", F.when(F.col("depth") > 0, F.element_at("trail", F.greatest("depth", F.lit(1)))))
        .groupBy("host", "depth", "node", "parent").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]), "url-nodes")
    deepest = counted.agg(F.max("depth")).first()[0] or 0
    done = counted.where("depth = 0").select(
        "host", "node", "depth", F.lit(None).cast("string").alias("branch"),
        (F.col("blocked") / (F.col("labelled") + smoothing)).alias("purity"))
    for depth in range(1, deepest + 1):
        own = counted.where(F.col("depth") == depth)
        pooled = own.groupBy("host", "parent").agg(F.sum("labelled").alias("all_labelled"),
                                                   F.sum("blocked").alias("all_blocked"))
        child = own.join(pooled, ["host", "parent"])
        # this child against its siblings without it
        m, b = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
        share = F.try_divide("all_blocked", "all_labelled")
        spread = share * (1 - share) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), m))
        gap = F.abs(F.try_divide("blocked", "labelled") - F.try_divide(b, m))
        apart = (spread > 0) & (gap > z * F.sqrt(spread))
        child = child.withColumn("branch", F.when(F.coalesce(apart, F.lit(False)), F.col("node"))
                                 .otherwise(F.concat("parent", F.lit(MERGED))))
        merged = child.groupBy("host", "parent", "branch").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("k"))
        above = done.where(F.col("depth") == depth - 1).select(
            "host", F.col("node").alias("parent"), F.col("purity").alias("prior"))
        level = (child.select("host", "parent", "node", "depth", "branch")
                 .join(merged, ["host", "parent", "branch"]).join(above, ["host", "parent"])
                 .select("host", "node", "depth", "branch",
                         ((F.col("k") + smoothing * F.col("prior")) / (F.col("l") + smoothing)).alias("purity")))
        done = done.unionByName(settle(level, "url-purity"))
    return done, deepest


def judge(pages: DataFrame, rules=RULES, purity: float = 0.8, smoothing: float = 4.0, z: float = 2.58) -> DataFrame:
    """page_id, host, path, rule, verdict, template and the template's purity."""
    host, path = parts(F.col("url"))
    split = settle(pages.select("page_id", host.alias("host"), path.alias("path"))
                   .withColumn("rule", matched(F.col("host"), F.col("path"), rules)), "urls")
    blocking = [r.name for r in rules if r.verdict == "block"]
    seen = split.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("rule").alias("labelled"),
        F.sum(F.when(F.col("rule").isin(blocking), 1).otherwise(0)).alias("blocked"))
    tree = settle(templates(seen), "url-tree")
    pure, _ = purities(tree, smoothing, z)
    leaf = tree.select("host", "path", F.element_at("trail", -1).alias("node")).join(
        pure.select("host", "node", "branch", "purity"), ["host", "node"]).select(
        "host", "path", F.col("node").alias("template"), "branch", "purity")
    verdict = (F.when(F.col("rule").isin(blocking), "block").when(F.col("rule").isNotNull(), "allow")
               .when(F.col("purity") >= purity, "block").otherwise("allow"))
    return split.join(leaf, ["host", "path"]).select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 9).alias("purity"))

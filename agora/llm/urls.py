"""Operator 4: URL filters by link-graph propagation.

Explicit rules decide where they fit. Elsewhere the host decides: trust is a
personalised PageRank that starts at hosts with allowed pages and follows links;
distrust is one that starts at hosts with blocked pages and follows links
backwards, so that hosts which link to bad ones are suspect. A host starts with
the share of its pages that the rules allow or block. It is blocked where its
distrust is more than its trust and at least `threshold` times that of a host
all of whose pages are blocked and to which nothing else leads; so a threshold
means the same for every size of graph.

Only built-in functions are used. Edges are summed per pair of hosts before they
are shuffled, scores are one row per host, and every step is checkpointed.
Null urls and urls without `://` have an empty host, which no rule fits and no
score reaches, so they are allowed. Null html has no links. Repeated pages count
as often as they occur; empty tables give empty results.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-4, 0.5
LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(rest: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(rest: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null if none does."""
    name = said = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, said = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(verdict)).otherwise(said)
    return name, said


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, score): personalised PageRank of weighted edges (src, dst, n) from seeds (host, weight), in the seeds' unit.

    Mass at hosts without links out is dropped, not redistributed. It ends when less than `tolerance` of it still flows,
    after log(tolerance) / log(damping) steps at most; with `steps`, after so many at the latest.
    """
    total = seeds.agg(F.sum("weight")).first()[0] or 1.0
    start = checkpointed(seeds.select("host", (F.col("weight") * (1 - damping)).alias("score")))
    if edges.isEmpty():
        return start
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    share = checkpointed(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all") * damping).alias("share")))
    flow = result = start
    for _ in itertools.count() if steps is None else range(steps):  # result sums the mass after 0, 1, 2 ... links
        flow = checkpointed(flow.join(share, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("score")), forget=True)
        if (flow.agg(F.sum("score")).first()[0] or 0) < tolerance * (1 - damping) * total:
            break
        result = checkpointed(result.unionAll(flow).groupBy("host").agg(F.sum("score").alias("score")), forget=True)
    return result


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, path, rule, verdict, trust and distrust of each page."""
    raw = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rest = after_scheme(F.col("url"))
    split = raw.select("id", host_of(rest).alias("host"), path_of(rest).alias("path"), "html")
    name, said = rule_columns(rules)
    ruled = checkpointed(split.select("id", "host", "path", name.alias("rule"), said.alias("said"), F.regexp_extract_all("html", F.lit(LINK), 1).alias("links")))
    links = ruled.where("host != ''").select("host", F.explode("links").alias("link"))
    target = F.translate(F.regexp_extract("link", "//([^/?#]*)", 1), UPPER, LOWER)
    edges = checkpointed(links.select(F.col("host").alias("src"), target.alias("dst")).where("dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n")))
    seeds = checkpointed(ruled.where("host != ''").groupBy("host").agg((F.count_if(F.col("said") == "allow") / F.count("*")).alias("good"), (F.count_if(F.col("said") == "block") / F.count("*")).alias("bad")))
    trust = pagerank(edges, seeds.where("good > 0").select("host", F.col("good").alias("weight")))
    distrust = pagerank(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), seeds.where("bad > 0").select("host", F.col("bad").alias("weight")))
    scores = checkpointed(trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionAll(distrust.select("host", F.lit(0.0), "score")).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold * (1 - DAMPING))
    own = F.when(F.coalesce(blocked, F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.drop("links").join(scores, "host", "left").select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))

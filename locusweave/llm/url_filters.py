"""URL filters: longest-match rules, and link-graph propagation for hosts that no rule judges.

Trust flows along host links from hosts with allowed pages, distrust flows against them from hosts with
blocked pages; both are personalised PageRanks run with DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the production list, (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(host, score): personalised PageRank over (src, dst, weight) from (host, seed); seeds are normalised.

    Mass of hosts without out-links is not handed on. Stops when a round moves less than `tolerance`: each moves at most
    `damping` times what the one before moved, so with 0.85 and 1e-6 that takes some 90 rounds at most, whatever the graph.
    """
    total = seeds.agg(F.sum("seed")).first()[0]
    base = cut(seeds.where("seed > 0").groupBy("host").agg((F.sum("seed") / F.lit(float(total or 1))).alias("seed")))
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")))
    score = base.select("host", F.col("seed").alias("score"))
    while True:
        moved = share.join(score, share["src"] == score["host"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        now = cut(
            base.withColumnRenamed("host", "h").join(moved, F.col("h") == F.col("dst"), "full")
            .select(F.coalesce("h", "dst").alias("host"), ((1 - damping) * F.coalesce("seed", F.lit(0.0)) + damping * F.coalesce("in", F.lit(0.0))).alias("score"))
        )
        old = score.withColumnRenamed("score", "old")
        gap = now.join(old, "host", "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        score = now
        if (gap or 0.0) < tolerance:
            return score


def judge_urls(
    pages: DataFrame, *, rules: tuple[tuple[str, str], ...] = RULES, ratio: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, host, path, rule, verdict) of every page; the longest rule decides, else the host's scores.

    A host is blocked if its distrust exceeds `ratio` times its trust; without either it is allowed. A null
    url, or one without ://, has empty host and path and no rule. Null html links nowhere. Repeated rows
    are judged alike and weigh twice as seeds; other columns are ignored.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0]))
    pick = lambda value: F.coalesce(*[F.when(_fits(r[1]), F.lit(value(r))) for r in ordered], F.lit(None).cast("string"))
    parsed = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    named = parsed.withColumns({"rule": pick(lambda r: r[1]), "by_rule": pick(lambda r: r[0])})
    light = written(named.select("id", "host", "path", "rule", "by_rule", F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda x: F.translate(x, UPPER, LOWER)).alias("to")), "urls")
    edges = cut(light.select(F.col("host").alias("src"), F.explode("to").alias("dst")).where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight")))
    seeds = cut(light.where("host <> ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad")))
    trust = propagate(edges, seeds.select("host", F.col("good").alias("seed"))).withColumnRenamed("score", "trust")
    distrust = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), seeds.select("host", F.col("bad").alias("seed"))).withColumnRenamed("score", "distrust")
    blocked = trust.join(distrust, "host", "full").where(F.coalesce("distrust", F.lit(0.0)) > ratio * F.coalesce("trust", F.lit(0.0))).select("host", F.lit("block").alias("by_host"))
    # Only unruled pages ask for their host's verdict; a host with a third of the rows is split by the join.
    return light.join(blocked, (light["host"] == blocked["host"]) & light["by_rule"].isNull(), "left").select(
        F.col("id").alias(id_col), light["host"], "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict")
    )

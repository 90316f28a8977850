"""Verdicts on urls by rules and by trust that spreads over links between hosts.

A rule is a host and a path: it fits its host and all subdomains where the url's
path starts with its own; of several the longest wins. Urls without a rule get
their host's verdict: trust is a personalised PageRank along links from hosts
whose pages the rules allow, distrust one against the links from hosts whose
pages they block. A host's seed is the share of its pages that the rules allow or
block, and scores are scaled so that a host without links keeps its seed; a host
is blocked when its distrust reaches ``threshold`` and exceeds its trust.

All of it is DataFrame operations. Links are summed to one weighted edge for each
pair of hosts before any iteration, so a page or a host with very many links costs
one row for each host it links to.

Defined results: a null url or one without ``://`` has empty host and path, no rule
and the verdict allow; null html has no links; repeated rows are judged each, and
count as pages; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import if_small
from weftgraph.session import cut

#: The rules of the query: action, then host and path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Links that name a host.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
DAMPING, ROUNDS, THRESHOLD = 0.85, 16, 0.5
#: Rounds between two cuts of the lineage.
CUT_EVERY = 4


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and action, or null. Rules are few: they become one CASE."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts."""
    linked = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("to"))
    linked = linked.select("src", _lower(F.col("to")).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return linked.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def spread(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, score: personalised PageRank over ``links`` (src, dst, weight) from ``seeds`` (host, seed).

    score = seed + damping * (what comes in), over as many rounds. What a host
    without links would pass on is dropped.
    """
    total = links.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(links.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total") * damping).alias("share")))
    score = seeds.select("host", F.col("seed").alias("score"))
    for i in range(rounds):
        came = score.join(share, score["host"] == share["src"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("came"))
        score = seeds.join(came, "host", "full").select("host", (F.coalesce("seed", F.lit(0.0)) + F.coalesce("came", F.lit(0.0))).alias("score"))
        if i % CUT_EVERY == CUT_EVERY - 1:
            score = cut(score)
    return score


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page's url."""
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    urls = named.select("page_id", "host", "path", matching_rule(F.col("host"), F.col("path"), rules).alias("r"))
    urls = urls.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.action").alias("action"))
    shares = cut(
        urls.groupBy("host").agg(
            F.avg(F.coalesce((F.col("action") == "allow").cast("double"), F.lit(0.0))).alias("allowed"),
            F.avg(F.coalesce((F.col("action") == "block").cast("double"), F.lit(0.0))).alias("blocked"),
        )
    )
    links = cut(host_links(named))
    trust, distrust = (shares.where("host <> ''").select("host", F.col(c).alias("seed")).where("seed > 0") for c in ("allowed", "blocked"))
    if links.isEmpty():  # nothing spreads: the seeds are the scores
        trust, distrust = (x.withColumnRenamed("seed", "score") for x in (trust, distrust))
    else:
        trust = spread(trust, links, damping, rounds)
        distrust = spread(distrust, links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), damping, rounds)
    scores = (
        shares.select("host")
        .join(trust.select("host", F.col("score").alias("trust")), "host", "left")
        .join(distrust.select("host", F.col("score").alias("distrust")), "host", "left")
        .fillna(0.0, ["trust", "distrust"])
    )
    by_host = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return urls.join(if_small(cut(scores)), "host").select("page_id", "host", "path", "rule", F.coalesce("action", by_host).alias("verdict"), "trust", "distrust")

"""URL filter: rules first, then trust and distrust carried over the link graph of hosts.

Personalised PageRank runs twice over the same host edges, forwards from trusted seeds and backwards
from blocked seeds. A host is judged by what the links bring it, not by its own seed.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dossier.llm.common import lower_ascii
from dossier.session import cut

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, ROUNDS, SETTLED, STRETCH = 0.85, 20, 1e-6, 5
RATIO = 1.0  # distrust above this multiple of trust blocks
_LINK = r"""(?i)\s(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, else nulls; of equal lengths the first listed.

    The rules are a short policy given by the caller, so they are part of the expression.
    """
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: each host's outgoing links by share; links inside a host are no evidence.

    Links are counted before they are shuffled, so a much linked host costs one row per task and source.
    """
    links = pages.select(host_of(F.col("url")).alias("src"),
                         F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("to"))
    counted = links.select("src", lower_ascii(F.col("to")).alias("dst")).filter(
        (F.col("src") != F.col("dst")) & (F.col("src") != "")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = counted.groupBy("src").agg(F.sum("n").alias("all"))
    return counted.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("weight"))


def _both_ways(edges: DataFrame) -> DataFrame:
    """Edges of the trust walk and, turned round, of the distrust walk, each with shares per start."""
    back = edges.groupBy("dst").agg(F.sum("weight").alias("all"))
    turned = edges.join(back, "dst").select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"),
                                            F.col("src").alias("dst"), (F.col("weight") / F.col("all")).alias("weight"))
    return edges.select(F.lit("trust").alias("walk"), "src", "dst", "weight").unionByName(turned)


def propagated(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``walk, host, carried``: rank that reaches a host over links, per walk, as a share of the walk's rank.

    ``seeds`` holds ``walk, host, mass``. Rank of hosts without links goes back to the seeds; that is the same
    as letting it leak and dividing by the rest, which needs no total in each round. A written table ends
    every fifth round, and the walk stops when a stretch of rounds moves less than ``SETTLED``.
    """
    edges = cut(_both_ways(edges))
    whole = seeds.groupBy("walk").agg(F.sum("mass").alias("all"))
    start = cut(seeds.join(whole, "walk").select(
        "walk", "host", ((1 - DAMPING) * F.col("mass") / F.col("all")).alias("rank")))
    rank, moved = start, 1.0
    for done in range(1, rounds + 1):
        passed = rank.join(edges, (rank.walk == edges.walk) & (rank.host == edges.src)).select(
            rank.walk, F.col("dst").alias("host"), (DAMPING * F.col("rank") * F.col("weight")).alias("rank"))
        rank = start.unionByName(passed).groupBy("walk", "host").agg(F.sum("rank").alias("rank"))
        if done % STRETCH == 0 or done == rounds:
            rank = cut(rank)
            total = rank.agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("t")).first()["t"]
            if abs(total - moved) < SETTLED:
                break
            moved = total
    sums = rank.groupBy("walk").agg(F.sum("rank").alias("all"))
    own = start.withColumnRenamed("rank", "own")
    return rank.join(own, ["walk", "host"], "left").join(sums, "walk").select(
        "walk", "host", ((F.col("rank") - F.coalesce("own", F.lit(0.0))) / F.col("all")).alias("carried"))


def verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, rounds: int = ROUNDS,
             ratio: float = RATIO) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages``.

    A rule decides where one fits; elsewhere a host is blocked if the distrust links carry to it is above
    ``ratio`` times the trust and above a hundredth of an even share. Seeds are hosts by the share of their
    pages that rules allow or block. Null urls, and urls without ``://``, have an empty host and path and
    are allowed unless a rule fits; null html holds no links; repeated rows stay; other columns are not read.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    ruled = named.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"))
    shares = ruled.filter(F.col("host") != "").groupBy("host").agg(
        F.avg((F.coalesce("says", F.lit("")) == "allow").cast("double")).alias("trust"),
        F.avg((F.coalesce("says", F.lit("")) == "block").cast("double")).alias("distrust"))
    seeds = shares.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (walk, mass)")).filter("mass > 0")
    carried = propagated(host_edges(pages), seeds, rounds)
    by_host = carried.groupBy("host").agg(*[
        F.sum(F.when(F.col("walk") == w, F.col("carried"))).alias(w) for w in ("trust", "distrust")])
    n_hosts = shares.agg(F.count("*")).scalar()
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    blocked = (distrust > ratio * trust) & (distrust * n_hosts > 0.01)
    return ruled.join(by_host, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("says", F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"))

"""URL filters: prefix rules first, else trust propagated over the host graph.

Trust is a personalised PageRank that restarts at hosts with pages the rules allow and follows
edges; distrust restarts at hosts with pages the rules block and follows edges backwards.  Both
run in one state table keyed by (host, kind), so an iteration is one join and one sum.  Edges are
the hyperlinks between hosts (relative links stay on the host) and the ties between a host and
its parent domain.  Everything is DataFrame operations: pages are reduced to distinct host edges
before any join, hubs are split by the skew join, and sums combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.results import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path prefix) of the registered query.
RULES = (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"),
    ("block", "example.net/de/8"), ("block", "org/es/"),
)
ITERATIONS, DAMPING = 12, 0.85
#: Iterations between two written stages, which bound the plan.
PER_STAGE = 4


def host_of(url: Column) -> Column:
    """Host in lower case (A-Z only); empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits; of two as long, one that blocks."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, ruled`` of every page."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct ``src, dst, n`` between hosts: links of the pages and ties to the parent domain."""
    linked = pages.select(
        host_of(F.col("url")).alias("src"),
        F.explode(F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)\shref\s*=\s*["']?(\w+://[^\s"'>]*|)"""), F.lit(1))).alias("to"),
    )
    links = linked.select("src", F.when(F.col("to") == "", F.col("src")).otherwise(host_of(F.col("to"))).alias("dst"))
    counted = links.where("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    hosts = pages.select(host_of(F.col("url")).alias("src")).where("src <> ''").distinct()
    up = hosts.select("src", F.expr("substring(src, instr(src, '.') + 1)").alias("dst")).where("instr(src, '.') > 0")
    ties = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1).cast("long"))
    return counted.unionByName(ties).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def host_scores(edges: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """``host, trust, distrust`` of every host that a seed's mass reaches.

    ``seeds`` has ``host, kind, n``: kind ``trust`` or ``distrust``; weights are shares of n
    within a kind.  Mass at a host without edges of its direction is not passed on.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    flow = materialise(both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")))
    mass = seeds.groupBy("kind").agg(F.sum("n").alias("mass"))
    start = materialise(seeds.join(mass, "kind").select("kind", "host", (F.col("n") / F.col("mass")).alias("start")))
    state = start.withColumnRenamed("start", "score")
    restart = start.select("kind", "host", (F.col("start") * (1 - damping)).alias("score"))
    for k in range(iterations):
        moved = state.join(flow, (state.host == flow.src) & (state.kind == flow.kind)).select(
            state.kind, F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score")
        )
        state = restart.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if (k + 1) % PER_STAGE == 0 and k + 1 < iterations:
            state = materialise(state)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    return state.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judge_pages(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, host_score`` of every page, one row per input row.

    The verdict is the rule's; without one, ``allow`` where trust makes at least ``threshold`` of
    the host's trust and distrust, or where neither reaches the host.  A null or unusable url has
    an empty host and path, fits no rule and is allowed; null html has no links.
    """
    j = judged(pages.select("page_id", "url"), rules)
    seeds = (
        j.where("ruled is not null and host <> ''")
        .groupBy("host", F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    scores = host_scores(host_edges(pages.select("url", "html")), seeds)
    scores = scores.select("host", (F.col("trust") / (F.col("trust") + F.col("distrust"))).alias("host_score"))
    return j.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.coalesce("host_score", F.lit(1.0)) >= threshold, "allow").otherwise("block")).alias("verdict"),
        "host_score",
    )

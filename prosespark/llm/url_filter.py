"""URL filter: rules by host and path, and for other hosts trust and distrust propagated along links between hosts.

Host edges come from absolute and scheme-relative links in the pages, counted per pair of hosts before any shuffle of
pages. A host's trust seed is the share of its pages that rules allow, its distrust seed the share that rules block.
Trust is personalised PageRank along links; distrust runs on the reversed links, so hosts that link to blocked ones are
distrusted. Seeds and scores aren't divided by their sums: mass that reaches a host without links ends there, and what is
left, divided by its sum, is the very PageRank in which such mass goes back to the seeds; undivided scores compare hosts
alike in graphs of any size. Rounds go on until no score moves by more than TOLERANCE in EVERY of them. A host is blocked
where distrust exceeds trust by more than LIMIT, which is the score of an unlinked host with half of its pages blocked;
a page that no rule fits takes its host's verdict.

Null urls and urls without `://` have an empty host and path and are allowed. Null html has no links. Repeated rows
count each. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosespark.llm.common import materialize

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, TOLERANCE, EVERY = 0.85, 1e-6, 5
LIMIT = (1 - DAMPING) * 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise(F.lit(""))


def with_host(pages: DataFrame) -> DataFrame:
    rest = F.coalesce(after_scheme(F.col("__u")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("__u", F.col("url").cast("string")).withColumn("host", host).withColumn("path", path).drop("__u")


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(RULES, key=lambda x: len(x[0] + x[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n of links between different hosts."""
    link = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), 1))
    dst = F.translate(F.regexp_extract("link", r"^(?i:https?:)?//([^/?#]*)", 1), UPPER, LOWER)
    links = pages.where(F.col("host") != "").select(F.col("host").alias("src"), link.alias("link")).select("src", dst.alias("dst"))
    return links.where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, seed: str, src: str, dst: str) -> DataFrame:
    """host, score: (1 - d) seed + d * what linking hosts pass on, each split by its link counts."""
    total = edges.groupBy(F.col(src).alias("s")).agg(F.sum("n").alias("total"))
    step = materialize(edges.join(total, edges[src] == total["s"]).select(F.col(src).alias("s"), F.col(dst).alias("t"), (F.col("n") / F.col("total")).alias("w")), "host-steps")
    base = seeds.select("host", (F.lit(1 - DAMPING) * F.col(seed)).alias("base"))
    if step.isEmpty():
        return base.select("host", F.col("base").alias("score"))
    hosts = base.select("host").unionByName(step.select(F.col("t").alias("host"))).unionByName(step.select(F.col("s").alias("host"))).distinct()
    base = materialize(hosts.join(base, "host", "left").select("host", F.coalesce("base", F.lit(0.0)).alias("base")), "host-seeds")
    score = base.select("host", F.col("base").alias("score"))
    while True:
        before = score
        for _ in range(EVERY):
            got = step.join(score, step["s"] == score["host"]).groupBy("t").agg(F.sum(F.col("w") * F.col("score")).alias("got"))
            score = base.join(got, base["host"] == got["t"], "left").select("host", (F.col("base") + F.lit(DAMPING) * F.coalesce("got", F.lit(0.0))).alias("score"))
        score = materialize(score, "host-scores")
        moved = score.join(before.select(F.col("host").alias("h"), F.col("score").alias("was")), F.col("host") == F.col("h")).agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0]
        if (moved or 0.0) <= TOLERANCE:
            return score


def judged(pages: DataFrame) -> DataFrame:
    """Every row of pages with host, path, rule, verdict, and its host's trust and distrust."""
    thin = with_host(pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    rule, by_rule = rule_of(F.col("host"), F.col("path"))
    rows = thin.select("page_id", "host", "path", rule.alias("rule"), by_rule.alias("by_rule"))
    seeds = rows.groupBy("host").agg(F.avg((F.coalesce("by_rule", F.lit("")) == "allow").cast("double")).alias("trusted"), F.avg((F.coalesce("by_rule", F.lit("")) == "block").cast("double")).alias("blocked"))
    seeds = materialize(seeds.where("host <> ''"), "host-shares")
    edges = materialize(host_edges(thin), "host-edges")
    trust = propagate(seeds, edges, "trusted", "src", "dst").select(F.col("host").alias("h"), F.col("score").alias("trust"))
    distrust = propagate(seeds, edges, "blocked", "dst", "src").select(F.col("host").alias("g"), F.col("score").alias("distrust"))
    scores = trust.join(distrust, F.col("h") == F.col("g"), "full").select(F.coalesce("h", "g").alias("scored"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    own = F.when(F.col("distrust") - F.col("trust") > LIMIT, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(scores, F.col("host") == F.col("scored"), "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "trust", "distrust")


def op10(pages: DataFrame) -> DataFrame:
    return judged(pages)

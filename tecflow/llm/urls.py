"""URL filters: rules, and trust and distrust spread over the link graph of hosts, in DataFrame operations only.

Hosts whose pages are for the most part decided by rules are seeds: trusted ones
by allow rules, blocked ones by block rules, weighing as much as that share.
Trust is the personalised PageRank that starts from the trusted seeds and follows
links; distrust starts from the blocked seeds and follows links backwards, from a
host to those that link to it. Both are scaled so that a seed of weight one
without links has one. A host is blocked when its distrust exceeds its trust by
MARGIN. The rules decide where one fits, the host's verdict elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, drop_staged, staged

#: Part of a score that follows links, weight of all walks that are left out, share that makes a seed, and what blocks.
DAMPING, SETTLED, SEED_SHARE, MARGIN = 0.85, 1e-6, 0.5, 0.1
#: Tables of walks that are held before they are summed.
FOLDED = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An absolute or protocol-relative link of a page.
LINK = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?\\s*((?:https?:)?//[^\"'>\\s]+)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A to Z in lower case; empty without :// or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else null; rules are configuration, each one branch of the plan."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, w): how many links pages of host src have to another host dst."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1))).alias("link"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return links.select("src", host_of(absolute).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, score): personalised PageRank of seeds (host, weight) over edges (src, dst, w), times the seeds' total weight.

    What has no way on, or sits on hosts without links, goes back to the seeds, so
    the scores are those of walks that end there, scaled to the seeds' total. Walks
    are followed one link at a time, until all longer ones together weigh less than
    SETTLED; as each link passes on a part of DAMPING, that always comes. Only
    totals reach the driver; each step is staged.
    """
    total = seeds.agg(F.sum("weight")).first()[0]
    if not total:
        return seeds.select("host", F.col("weight").cast("double").alias("score")).limit(0)
    out = edges.groupBy("src").agg(F.sum("w").alias("out"))
    flow = staged(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p")), "flow")
    summed = lambda frames: staged(reduce(DataFrame.union, frames).groupBy("host").agg(F.sum("score").alias("score")), "scores")
    last, rest = staged(seeds.select("host", F.col("weight").cast("double").alias("score")), "walks"), total
    found = [last]
    while rest * DAMPING / (1 - DAMPING) > SETTLED:
        came = flow.join(last, flow.src == last.host).groupBy("dst").agg((DAMPING * F.sum(F.col("p") * F.col("score"))).alias("score"))
        before, last = last, staged(came.select(F.col("dst").alias("host"), "score"), "walks")
        if not any(before is f for f in found):
            drop_staged(before)
        rest = last.agg(F.sum("score")).first()[0] or 0.0
        found.append(last)
        if len(found) > FOLDED:
            whole = summed(found)
            drop_staged(*found[:-1])
            found = [whole]
    whole = summed(found)
    drop_staged(flow, *found)
    return whole.withColumn("score", F.col("score") * (total / whole.agg(F.sum("score")).first()[0]))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) for every row of pages.

    A null or malformed url has an empty host and path, fits no rule, is no seed
    and is allowed. Pages without html have no links. Repeated rows count as
    often as they stand there. Hosts that no trust or distrust reaches have 0 of it.
    """
    url = F.col(url_col).cast("string")
    host, path = host_of(url), path_of(url)
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.select(id_col, "host", "path", name.alias("rule"), verdict.alias("ruled"))
    share = lambda v: (F.count_if(F.col("ruled") == v) / F.count("*")).alias(v)
    shares = staged(ruled.where("host <> ''").groupBy("host").agg(share("allow"), share("block")), "shares")
    edges = staged(host_edges(pages, url_col, html_col), "edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    trust = spread(edges, shares.where(F.col("allow") >= SEED_SHARE).select("host", F.col("allow").alias("weight")))
    distrust = spread(back, shares.where(F.col("block") >= SEED_SHARE).select("host", F.col("block").alias("weight")))
    drop_staged(shares, edges)
    both = trust.select("host", F.col("score").alias("t"), F.lit(0.0).alias("d")).union(distrust.select("host", F.lit(0.0), "score"))
    scores = both.groupBy("host").agg(F.sum("t").alias("trust"), F.sum("d").alias("distrust"))
    scores = staged(scores.where("trust <> 0 or distrust <> 0"), "scores")
    out = ruled.join(bounded(scores, 80 + F.octet_length("host")).withColumnRenamed("host", "scored"), F.col("host") == F.col("scored"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(distrust - trust >= MARGIN, "block").otherwise("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))

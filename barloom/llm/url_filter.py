"""URL filtering by rules and by trust propagated over the link graph of hosts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, AFTER_SCHEME, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule (action, "host/path") that fits, else null.

    Rules are configuration that the driver holds; of equal ones the first given wins.
    """
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for action, rule in sorted(reversed(list(rules)), key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(src, dst, verdict, weight): links between hosts, by the verdict of the rule that fits the linked url, if any.

    Absolute and protocol-relative links count for the host they name. A relative link stays on its host and
    is left out.
    """
    links = pages.where("host <> ''").select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link")
    )
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    named = links.select("src", host_of(target).alias("dst"), path_of(target).alias("path")).where("dst <> '' and dst <> src")
    verdict = matched_rule(F.col("dst"), F.col("path"), rules)["verdict"].alias("verdict")
    return named.groupBy("src", "dst", verdict).agg(F.count("*").cast("double").alias("weight"))


def host_edges(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, weight): links between hosts, and each host with the host one label above it.

    A subdomain belongs to the host above it, which is an edge of weight 1 in either direction
    where both hosts have pages; without it hosts that no page links to would never be reached.
    """
    linked = links.select("src", "dst", "weight")
    hosts = pages.where("host <> ''").select("host").distinct()
    above = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("dst"))
    pairs = above.join(hosts.select(F.col("host").alias("dst")), "dst").select("src", "dst", F.lit(1.0).alias("weight"))
    both = linked.unionByName(pairs).unionByName(
        pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, cut: int = 4) -> DataFrame:
    """Personalised PageRank from `trusted` over the edges and from `blocked` over the reversed edges.

    `seeds` has (host, trusted, blocked) per host, both as shares of their sums. Trust goes from a page to
    what it links to; distrust goes from a target back to those who link to it. Every `cut` rounds the
    ranks are written, which ends their lineage. The last `cut` rounds reach no further host and move the ranks
    by at most `tolerance` in sum, of a total of one each; distance to a seed has no limit.
    """
    flow = materialize(
        edges.join(edges.groupBy("src").agg(F.sum("weight").alias("out")), "src")
        .select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit(True).alias("trust"), (F.col("weight") / F.col("out")).alias("share"))
        .unionByName(
            edges.join(edges.groupBy("dst").agg(F.sum("weight").alias("in")), "dst").select(
                F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(False).alias("trust"), (F.col("weight") / F.col("in")).alias("share")
            )
        ),
        "flow",
    )
    seeds = materialize(seeds, "seeds")
    ranks = seeds.select("host", F.col("trusted").alias("trust_rank"), F.col("blocked").alias("block_rank"))
    before, reached = seeds.select("host", F.col("trusted").alias("t0"), F.col("blocked").alias("b0")), None
    for k in count():
        sent = flow.join(ranks, flow["from"] == ranks["host"]).select(
            F.col("to"),
            F.when(F.col("trust"), F.col("share") * F.col("trust_rank")).otherwise(0.0).alias("t"),
            F.when(F.col("trust"), 0.0).otherwise(F.col("share") * F.col("block_rank")).alias("b"),
        )
        got = sent.groupBy(F.col("to").alias("host")).agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
        ranks = seeds.join(got, "host", "left").select(
            "host",
            ((1 - damping) * F.col("trusted") + damping * F.coalesce("t", F.lit(0.0))).alias("trust_rank"),
            ((1 - damping) * F.col("blocked") + damping * F.coalesce("b", F.lit(0.0))).alias("block_rank"),
        )
        if (k + 1) % cut == 0:
            ranks = materialize(ranks, "ranks")
            moved = F.abs(F.col("trust_rank") - F.col("t0")) + F.abs(F.col("block_rank") - F.col("b0"))
            far = [F.count_if(F.col(c) > 0) for c in ("trust_rank", "block_rank")]
            change, *now = ranks.join(before, "host").agg(F.sum(moved), *far).first()
            if (change or 0.0) <= tolerance and now == reached:
                return ranks
            before, reached = ranks.select("host", F.col("trust_rank").alias("t0"), F.col("block_rank").alias("b0")), now


def judge_urls(pages: DataFrame, rules: Sequence[Rule], damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """Add host, path, rule and verdict to `pages` (page_id, url, html).

    A url that a rule fits gets the rule's verdict. Hosts with such pages are the seeds, by their share of
    allowed and of blocked pages; a host that has no pages but is linked to counts by the links to it; a host is blocked where the distrust that reaches it exceeds the trust,
    and every other page of it gets that verdict. Hosts that neither reaches are allowed.

    Null or malformed urls have an empty host and path, no rule, and are allowed; null html has no links.
    Repeated pages are rows each and count each. Other columns are dropped. No rows give no rows.
    """
    # the text of the pages is read once, for its links; what follows is by host
    judged = pages.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("html"),
    ).withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules))
    links = materialize(host_links(judged, rules), "links")
    edges = materialize(host_edges(judged, links), "edges")
    allowed, blocked = F.col("_rule.verdict") == "allow", F.col("_rule.verdict") == "block"
    crawled = materialize(
        judged.where("host <> ''")
        .groupBy("host")
        .agg(
            F.sum(F.when(allowed, 1.0).otherwise(0.0)).alias("allowed"),
            F.sum(F.when(blocked, 1.0).otherwise(0.0)).alias("blocked"),
            F.count("*").cast("double").alias("pages"),
        ),
        "hosts",
    )
    linked = links.withColumnRenamed("dst", "host").groupBy("host").agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("weight")).otherwise(0.0)).alias("allowed"),
        F.sum(F.when(F.col("verdict") == "block", F.col("weight")).otherwise(0.0)).alias("blocked"),
        F.sum("weight").alias("pages"),
    )
    counts = crawled.unionByName(linked.join(crawled, "host", "left_anti"))
    share = counts.select("host", (F.col("allowed") / F.col("pages")).alias("a"), (F.col("blocked") / F.col("pages")).alias("b"))
    total = share.agg(F.sum("a"), F.sum("b")).first()
    seeds = share.select("host", (F.col("a") / (total[0] or 1.0)).alias("trusted"), (F.col("b") / (total[1] or 1.0)).alias("blocked"))
    ranks = propagate(seeds, edges, damping, tolerance)
    bad = materialize(ranks.where("block_rank > trust_rank").select("host", F.lit(True).alias("_bad")), "blocked")
    return (
        judged.drop("html")
        .join(bad, "host", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("_rule.rule").alias("rule"),
            F.coalesce(F.col("_rule.verdict"), F.when(F.col("_bad"), "block").otherwise("allow")).alias("verdict"),
        )
    )

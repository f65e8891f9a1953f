"""URL filters: stated rules, and for all other urls trust and distrust spread over the host link graph.

Hosts whose pages rules allow are the seeds of trust, hosts whose pages rules block those of distrust, both in
proportion to those pages. Trust is personalised PageRank along links (who is linked from trusted hosts is trusted);
distrust is the same on reversed links (who links to blocked hosts is distrusted). A host is blocked where its distrust
exceeds its trust by ``THRESHOLD``; hosts that neither reaches are allowed.

Edges are links between hosts, weighted by the linking pages of the host, and the tie between a host and its parent
domain where both have pages (``www.a.org`` and ``a.org``). They are aggregated before any join, so no host's pages meet
in a task. Ranks are written to the shared folder every ``ROUNDS_PER_WRITE`` rounds,
until they change by less than ``TOLERANCE`` from one write to the next.
"""

from __future__ import annotations

import string
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotyard.session import hand_over

DAMPING, ROUNDS, ROUNDS_PER_WRITE = 0.85, 20, 5
TOLERANCE = 1e-6  # summed change of ranks between writes at which the rounds end, after about 90 at worst
THRESHOLD = 0.0
MAX_RULES = 1_000
HREF = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//[^\s"'<>]+"""


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits as struct(rule, action), null if none does. ``rules`` are (action, host and path), a stated
    list of at most ``MAX_RULES``; of equally long ones the first in order of text wins."""
    if len(rules) > MAX_RULES or {a for a, _ in rules} - {"allow", "block"}:
        raise ValueError("rules are a short list of (allow or block, host/path)")
    fits = []
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        inside = (host == name) | host.endswith(f".{name}")
        fits.append(F.when(inside & path.startswith(slash + rest), F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,action:string>"))


def host_edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``weight``: linking pages between different hosts, and ties of hosts to their parent domains. ``pages`` has
    ``host`` and ``html``."""
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(0)), lambda a: url_host(F.concat(F.lit("x:"), F.regexp_extract(a, r"(//[\s\S]*)$", 1)))))
    linked = pages.filter(F.col("html").contains("//")).select(F.col("host").alias("src"), F.explode(links).alias("dst"))
    linked = linked.filter("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = pages.select("host").filter("host <> ''").distinct()
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
    kin = hosts.select("host", parent.alias("parent")).filter("parent <> ''")
    kin = kin.join(hosts.withColumnRenamed("host", "parent"), "parent", "left_semi")
    ties = kin.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("parent").alias("dst")), F.struct(F.col("parent").alias("src"), F.col("host").alias("dst")))).alias("e"))
    both = linked.unionByName(ties.select("e.src", "e.dst", F.lit(1.0).alias("weight")))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread_scores(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = ROUNDS) -> DataFrame:
    """``host``, ``trust``, ``distrust``: personalised PageRank of ``seeds`` (``host``, ``trust``, ``distrust``, weights at least 0)
    along ``edges``, and against them. Rank of hosts without outgoing edges returns to the seeds. Hosts that nothing
    reaches are absent. Ends after ``rounds`` at most; with None only when the ranks are settled to ``TOLERANCE``."""
    forth = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight")
    back = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    graph = forth.unionByName(back)
    total = graph.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    graph = hand_over(graph.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "host-graph")
    kinds = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "weight"))
    kinds = kinds.filter("weight > 0").groupBy("kind", "host").agg(F.sum("weight").alias("weight"))
    whole = kinds.groupBy("kind").agg(F.sum("weight").alias("whole"))  # two rows
    seed = hand_over(kinds.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("weight") / F.col("whole")).alias("seed")), "host-seeds")
    ranks = written = seed.withColumnRenamed("seed", "rank")
    for done in count(1):
        moved = graph.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"])
        moved = moved.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("into"))
        given = moved.groupBy("kind").agg(F.sum("into").alias("given"))  # two rows
        mixed = moved.join(seed, ["kind", "host"], "full").join(F.broadcast(given), "kind", "left")
        rank = damping * F.coalesce("into", F.lit(0.0)) + (1 - damping * F.coalesce("given", F.lit(0.0))) * F.coalesce("seed", F.lit(0.0))
        ranks = mixed.select("kind", "host", rank.alias("rank"))
        if done % ROUNDS_PER_WRITE == 0 or done == rounds:
            ranks = hand_over(ranks, "host-ranks")
            before = written.withColumnRenamed("rank", "before")
            change = ranks.join(before, ["kind", "host"], "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))))
            if (change.first()[0] or 0.0) < TOLERANCE or done == rounds:
                break
            written = ranks
    score = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    return ranks.groupBy("host").agg(score("trust"), score("distrust"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``trust``, ``distrust`` and ``verdict``, a row per page.

    ``pages`` needs ``page_id``, ``url`` and ``html``; other columns are ignored. A null url or one without ``://`` has empty host
    and path, no score, and is allowed. A null html has no links. Repeated rows are each judged.
    """
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col("html").cast("string"))
    judged = parsed.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    by_rule = lambda action: F.sum((F.col("fit.action") == action).cast("double"))
    seeds = judged.filter("fit IS NOT NULL AND host <> ''").groupBy("host").agg(
        by_rule("allow").alias("trust"), by_rule("block").alias("distrust")
    )
    scores = spread_scores(host_edges(parsed), seeds, rounds=None)
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    verdict = F.coalesce("fit.action", F.when(distrust - trust > threshold, "block").otherwise("allow"))
    return judged.drop("html").join(scores, "host", "left").select(
        "page_id", "host", "path", "fit.rule", trust.alias("trust"), distrust.alias("distrust"), verdict.alias("verdict")
    )

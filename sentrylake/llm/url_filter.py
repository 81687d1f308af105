"""Operator 8: URL filter with a path-template tree per host (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.text import cut

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE_SHARE = 0.02
LEAST_CHILDREN = 20
STRENGTH = 2.0
PURITY = 0.8
Z = 1.96


def host_of(url: Column) -> Column:
    tail = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    tail = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits; nulls where none does."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def wildcards(leaves: DataFrame) -> DataFrame:
    """(leaf, g): each leaf's segments with the rare ones of many siblings as wildcards.

    leaves: (leaf, host, segments, n). Siblings are the segments after one beginning of
    a host's paths, at whatever depth.
    """
    each = leaves.select("leaf", "host", "n", "segments", F.posexplode("segments").alias("i", "s"))
    each = each.select("leaf", "host", "n", "i", "s", F.xxhash64(F.slice("segments", 1, F.col("i"))).alias("parent"))
    siblings = each.groupBy("host", "i", "parent", "s").agg(F.sum("n").alias("n"))
    every = siblings.groupBy("host", "i", "parent").agg(F.sum("n").alias("all"), F.count_if(F.col("s") != "*").alias("kids")).filter(F.col("kids") >= LEAST_CHILDREN)
    rare = siblings.join(every, ["host", "i", "parent"]).filter((F.col("s") != "*") & (F.col("n") < RARE_SHARE * F.col("all"))).select("host", "i", "parent", "s", F.lit("*").alias("g"))
    named = each.join(rare, ["host", "i", "parent", "s"], "left").groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("g", "s").alias("g")))).alias("g"))
    return leaves.select("leaf").join(named, "leaf", "left").select("leaf", F.coalesce(F.transform("g", lambda x: x["g"]), F.array().cast("array<string>")).alias("g"))


def purities(templates: DataFrame, p_all: float, strength: float) -> DataFrame:
    """(template, purity) from (template, host, g, labelled, blocked), g the template's segments."""
    m = F.lit(float(strength))
    hosts = templates.groupBy("host").agg(((F.sum("blocked") + m * F.lit(p_all)) / (F.sum("labelled") + m)).alias("p"))
    at = templates.select("template", "host", "g", "labelled", "blocked", F.posexplode("g").alias("i", "_")).select(
        "template", "host", "i", F.xxhash64(F.slice("g", 1, F.col("i"))).alias("parent"), F.xxhash64(F.slice("g", 1, F.col("i") + 1)).alias("node"), "labelled", "blocked"
    )
    nodes = at.groupBy("host", "i", "parent", "node").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    # siblings that the rate of all of them explains are one branch
    rate = F.try_divide("b_all", "l_all")
    spread = F.lit(Z) * F.sqrt(F.col("l") * rate * (1 - rate))
    like = F.coalesce(F.abs(F.col("b") - F.col("l") * rate) <= spread, F.lit(True))
    nodes = nodes.join(nodes.groupBy("host", "i", "parent").agg(F.sum("l").alias("l_all"), F.sum("b").alias("b_all")), ["host", "i", "parent"]).withColumn("like", like)
    merged = nodes.groupBy("host", "i", "parent", "like").agg(F.sum("l").alias("l_like"), F.sum("b").alias("b_like"))
    nodes = nodes.join(merged, ["host", "i", "parent", "like"]).select(
        "host", "i", "node", F.when(F.col("like"), F.col("l_like")).otherwise(F.col("l")).alias("l"), F.when(F.col("like"), F.col("b_like")).otherwise(F.col("b")).alias("b")
    )
    path = at.select("template", "host", "i", "node").join(nodes, ["host", "i", "node"]).groupBy("template").agg(F.sort_array(F.collect_list(F.struct("i", "l", "b"))).alias("path"))
    every = templates.select("template", "host").join(hosts, "host").join(path, "template", "left")
    purity = F.aggregate(F.coalesce("path", F.array().cast("array<struct<i:int,l:bigint,b:bigint>>")), F.col("p"), lambda p, x: (x["b"] + m * p) / (x["l"] + m))
    return every.select("template", purity.alias("purity"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", strength: float = STRENGTH, purity: float = PURITY) -> DataFrame:
    """Verdict for each page, by rule, or by its path template where no rule fits.

    Pages that a rule judges are the labelled ones. Each host has a tree of its whole
    paths, a level for each segment. A segment with a digit is a wildcard at once; one
    of at least LEAST_CHILDREN literal siblings becomes a wildcard too if fewer than
    RARE_SHARE of the pages under their parent have it. Sibling branches whose
    labelled block counts lie within Z standard deviations of the rate of all of them
    are merged: they share their counts. A node's purity is its share of blocked
    labelled pages, drawn towards its parent's, and so on up to the host's and the whole
    table's (at most a half), with `strength` pseudo-pages at each step; a template
    whose last node has `purity` or more is rejected.

    Null urls and urls without ``://`` have an empty host and path and are judged
    as templates of that host; an empty table gives an empty result. Long urls have
    trees as deep as they are. Repeated rows each count and each return a row. Columns
    of other names, or of the names that come back, are not looked at. Only counts are
    grouped (combined before the shuffle), so a hot host is a hot key of a joined table
    only, which adaptive execution splits.
    """
    u = F.col(url)
    base = pages.select("page_id", host_of(u).alias("host"), path_of(u).alias("path"))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("ruled", ruled)
    general = lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(s)
    base = base.withColumn("segments", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), general))
    found = base.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    leaves = cut(found.withColumn("leaf", F.monotonically_increasing_id()))
    blocked, labelled = leaves.agg(F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()  # two numbers
    p_all = min(0.5, (blocked + 1) / (labelled + 2))  # without labels of its own nothing is rejected
    named = cut(leaves.join(wildcards(leaves), "leaf"))
    templates = cut(named.groupBy("host", "g").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).withColumn("template", F.monotonically_increasing_id()))
    rated = templates.join(purities(templates, p_all, strength), "template").select("host", "g", "purity")
    judged = named.join(rated, ["host", "g"]).select("host", "segments", F.concat(F.lit("/"), F.array_join("g", "/")).alias("template"), "purity")
    out = base.join(judged, ["host", "segments"])
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("purity") >= purity, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")

"""Operator 9: mixing sources to target weights by entropy balancing (DataFrame functions only).

A source's constraint is on its tokens; the dual has one multiplier a source, found by
Newton steps whose sums are Spark aggregates over all documents' sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.text import WORD_SQL, cut

#: Rows that one cell of a (source, size) group has at most, about.
CELL_ROWS = 1024
#: Bound on Newton steps, and the gap in words, or as a share of the target, at which a source is settled.
NEWTON_STEPS, NEAR_WORDS, NEAR_SHARE = 100, 0.25, 1e-10
KEY = ["_s", "_n"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target of each source, from a table (source, source_size) with one row a source.

    Sources in code-point order (null last) take `weights` in turn and share `share` of
    all sizes; no target passes `cap` times its source's size, and what is cut goes to
    the others by weight. At the level L where that ends a target is
    min(cap * size, L * weight); sorting by cap * size / weight finds L with running
    sums, in place of repeated resharing.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = sizes.withColumn("weight", w).withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    rising = Window.orderBy("ratio", F.col("source").isNull(), "source")
    every = Window.partitionBy()
    t = t.withColumn("cut_before", F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("weight_left", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("all_tokens", F.sum("source_size").over(every) * F.lit(float(share)))
    t = t.withColumn("at", (F.col("all_tokens") - F.col("cut_before")) / F.col("weight_left"))
    t = t.withColumn("level", F.max(F.when(F.col("at") <= F.col("ratio"), F.col("at"))).over(every))
    return t.withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))).select("source", "source_size", "target")


def solve_tilts(groups: DataFrame, targets: DataFrame, cap: float = 2.0) -> DataFrame:
    """(_s, _n, source_size, target, scale, lam, full): the dual's solution for each source.

    groups: (_s, _n, size, n), how many documents of a source have a size; targets:
    (_s, _n, source_size, target). Of all rates 0 <= r <= cap that meet every target,
    those with the least sum of r ln r - r are r = min(cap, exp(lam size / scale)),
    with one multiplier lam a source. Each Newton step is one aggregate over all groups,
    which gives every source's tokens and their slope; the step that leaves the
    bracket found so far is replaced by its middle. A source whose target is its cap
    is full: there lam has no bound.
    """
    size, n = F.col("size"), F.col("n")
    scale = groups.groupBy(*KEY).agg((F.sum(n * size * size) / F.greatest(F.sum(n * size), F.lit(1))).alias("scale"))
    none = F.lit(None).cast("double")
    state = targets.join(scale, KEY).select(
        *KEY, "source_size", "target", F.greatest("scale", F.lit(1.0)).alias("scale"), F.lit(0.0).alias("lam"), none.alias("lo"), none.alias("hi"),
        (F.col("target") >= F.lit(cap) * F.col("source_size") * (1 - 1e-12)).alias("full"), ((F.col("source_size") == 0) | (F.col("target") >= F.lit(cap) * F.col("source_size") * (1 - 1e-12))).alias("settled"),
    )
    state = cut(state)
    for _ in range(NEWTON_STEPS):
        if state.filter("not settled").isEmpty():
            break
        tilted = groups.join(state.filter("not settled").select(*KEY, "lam", "scale"), KEY).withColumn("e", F.exp(F.col("lam") * size / F.col("scale")))
        seen = tilted.groupBy(*KEY).agg(
            F.sum(n * size * F.least("e", F.lit(float(cap)))).alias("got"), F.sum(F.when(F.col("e") < cap, n * size * size / F.col("scale") * F.col("e")).otherwise(0.0)).alias("slope")
        )
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        reach = 1 + 2 * F.abs("lam")  # a step without a bracket goes so far at most
        step = F.coalesce(F.try_divide(-gap, "slope"), -F.signum(gap) * reach)
        newton = F.col("lam") + F.greatest(-reach, F.least(reach, step))
        inside = (newton > F.coalesce("_lo", F.lit(float("-inf")))) & (newton < F.coalesce("_hi", F.lit(float("inf"))))
        near = F.abs(gap) <= F.greatest(F.lit(NEAR_WORDS), F.lit(NEAR_SHARE) * F.col("target"))
        done = F.col("settled") | F.coalesce(near, F.lit(True))
        state = state.join(seen, KEY, "left").withColumn("_lo", lo).withColumn("_hi", hi)
        state = cut(state.select(*KEY, "source_size", "target", "scale", F.when(done, F.col("lam")).when(inside, newton).otherwise((F.col("_lo") + F.col("_hi")) / 2).alias("lam"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "full", done.alias("settled")))
    return state.select(*KEY, "source_size", "target", "scale", "lam", "full")


def group_copies(groups: DataFrame, tilts: DataFrame, cap: float = 2.0) -> DataFrame:
    """(_s, _n, size, n, source_size, target, rate, all_copies): how often the documents of a group are taken together.

    A group's copies are its rate's, rounded. What the roundings leave of a source's
    target is made up by the smallest documents: groups in order of size take as many
    copies more, or fewer, as they can, until it is passed by less than one such
    document. That is made up in the same way by smaller ones, and so on.
    """
    size, n = F.col("size"), F.col("n")
    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("lam") * size / F.col("scale"))))
    g = groups.join(tilts, KEY).withColumn("rate", rate).withColumn("all_copies", F.floor(n * F.col("rate") + 0.5))
    every = Window.partitionBy(*KEY)
    before = every.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    for last in (False, False, False, True):
        g = g.withColumn("_left", F.col("target") - F.sum(F.col("all_copies") * size).over(every))
        g = g.withColumn("_room", F.when(size == 0, F.lit(0)).when(F.col("_left") > 0, F.floor(n * F.lit(float(cap))) - F.col("all_copies")).otherwise(F.col("all_copies")))
        wanted = (F.abs("_left") - F.coalesce(F.sum(F.col("_room") * size).over(before), F.lit(0))) / F.greatest(size, F.lit(1))
        more = F.greatest(F.lit(0), F.least(F.col("_room"), F.floor(wanted + 0.5) if last else F.ceil(wanted)))
        g = g.withColumn("all_copies", F.col("all_copies") + F.signum("_left").cast("long") * more)
    return g.withColumn("all_copies", F.col("all_copies").cast("long")).select(*KEY, "size", "n", "source_size", "target", "rate", "all_copies")


def mix_sources(docs: DataFrame, carry: Sequence[str] = (), weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Copies of each document so that every source comes near its share of tokens.

    Returns doc_id, size, source, source_size, target, rate, copies, taken and the
    columns in `carry`. Rates are exponentially tilted by a document's size
    (solve_tilts), so they depend on source and size only; all steps before the last
    run on one row for each pair of these (at most a row for each length that occurs).
    The copies of a group are spread evenly over its documents by rank. Ranks need no
    sort of a whole group: documents are dealt by hash into cells of about CELL_ROWS,
    ranked inside their cell, and moved by the count of the cells before, so a hot
    source or size is spread over many tasks.

    Null and empty text has size 0 and is taken once; null source is a source of its
    own. Repeated rows are documents of their own and ties in rank are among rows of
    one doc_id; reruns agree as only doc_id, size and source decide. Very long texts
    only count. Columns of any other name are carried as they are. An empty table
    gives an empty result.
    """
    # null sources as a flag beside a text, so that windows and joins share one partitioning
    base = docs.select(
        "doc_id", F.col("source"), word_count(F.col("text")).alias("size"), F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )
    base = base if carry else cut(base)
    groups = cut(base.groupBy(*KEY, "size").agg(F.count("*").alias("n")))
    sizes = groups.groupBy(*KEY).agg(F.sum(F.col("n") * F.col("size")).alias("source_size")).withColumn("source", F.when(~F.col("_n"), F.col("_s")))
    targets = cut(sizes.select(*KEY).join(_keyed(source_targets(sizes.select("source", "source_size"), weights, share, cap)), KEY))
    plan = cut(group_copies(groups, solve_tilts(groups, targets, cap), cap))
    cell = [*KEY, "size", "_h"]
    placed = base.join(plan.select(*KEY, "size", F.ceil(F.col("n") / CELL_ROWS).alias("_cells")), [*KEY, "size"])
    placed = placed.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.col("_cells"))).drop("_cells")
    placed = placed if carry else cut(placed)
    before = Window.partitionBy(*KEY, "size").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*cell).agg(F.count("*").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in")
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy(*cell).orderBy(F.xxhash64("doc_id", "size"), "doc_id")))
    out = ranked.join(cells.join(plan, [*KEY, "size"]), cell)
    k, n, all_copies = F.col("_before") + F.col("_rank"), F.col("n"), F.col("all_copies")
    whole, rest = F.floor(all_copies / n), F.pmod(all_copies, n)  # the rest times a rank stays below the square of a group's rows
    part = lambda i: whole * i + F.floor(rest * i / n)
    out = out.withColumn("copies", (part(k) - part(k - 1)).cast("long"))
    return out.select(
        "doc_id", "size", "source", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"_carry_{c}") for c in carry],
    )


def _keyed(t: DataFrame) -> DataFrame:
    return t.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull()).drop("source")


def repeat_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns as they came, whatever their names.

    Null and empty texts stay once; rows that repeat are documents of their own. An
    empty table gives an empty result.
    """
    mixed = mix_sources(docs, carry=docs.columns, **options)
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"_carry_{c}").alias(c) for c in docs.columns])

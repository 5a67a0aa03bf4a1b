"""Operator 7, mixing sources to target weights: entropy balancing. DataFrame functions only.

Every document gets a rate, the expected number of its copies in the mix, between 0 and `most`. Among
all rates for which each source's expected tokens equal its target, those nearest to one copy each
in relative entropy (of rate and most - rate) are the tilted ones

    rate_i = most * t / (1 + t),  t = exp(lambda_source * size_i / scale_source) / (most - 1),

where lambda solves the convex dual: the sum over the source of size * rate equals the target.
Newton's method finds it. Documents are first summed to (source, size, count), so an iteration reads
sizes instead of documents; gradients and curvatures are sums over the cluster, a row for each source
is what an iteration makes, and it is stored in the shared folder so that lineage stays short. A step
that leaves the bracket of known bounds is replaced by halving it.

Rates are rounded into copies by one threshold for each source: with u a hash of the document's key
in [0, 1), copies = floor(rate + u + delta), no more than `most`; a larger delta takes more. Passes
over histograms of where each document's copies change narrow the threshold to the last document
that fits below the target, then `fills` passes add, to each source, the largest document that still
fits. So reruns agree, and what a source misses of its target shrinks with each pass.

Targets: sources in code point order, null last, weigh `weights`, repeating, and share `budget`
times all tokens; a target stops at `most` times the source's size and the excess is shared again by
weight among the others until none is above (water filling: the level is raised by two sums over the
sources until no more of them fill up).

Defined cases: null or empty text: size 0, takes 0 tokens. Sources of size 0: target 0. Rows that
repeat (equal key, source and size) get equal copies. An empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import cut

BINS = 4096
#: exp() of the tilt stays finite below this.
STEEP = 600.0


def count_words(text: Column) -> Column:
    """How many words (runs without ASCII white space) a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with _rank: its place in code point order from 0 on, null last. Ranges are ranked side by side."""
    dealt = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    dealt = cut(dealt)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    # a row for each partition
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    here = F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("_here", here).join(before, "_part").withColumn("_rank", F.col("_before") + F.col("_here")).drop("_part", "_here", "_before")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: int = 2) -> DataFrame:
    """sources: (source, source_size), a row for each. Adds its target."""
    turn = F.pmod(F.col("_rank"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    s = cut(ranked(sources).withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most).drop("_rank"))
    total = budget * (s.agg(F.sum("source_size")).first()[0] or 0)
    # the level rises as sources fill up, until no more do; two sums reach the driver each time
    level = 0.0
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_w")
        caps, open_ = s.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
        if not open_:
            level = None
            break
        higher = max(0.0, total - (caps or 0)) / open_
        if higher <= level:
            break
        level = higher
    target = F.col("_cap") if level is None else F.least(F.lit(level) * F.col("_w"), F.col("_cap"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def tilt(lam: Column, x: Column, most: int) -> Column:
    """rate = most * t / (1 + t), with the exponent kept finite."""
    z = F.least(F.greatest(lam * x - math.log(most - 1), F.lit(-STEEP)), F.lit(STEEP))
    return most / (1 + F.exp(-z))


def solve(sizes: DataFrame, goals: DataFrame, most: int = 2, rounds: int = 40, close: float = 1e-6) -> DataFrame:
    """sizes: (source, size, n); goals: (source, source_size, target, scale). Adds lambda, `full` where every document gets `most` copies."""
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    # the tilt that solves the case of equal sizes
    share = F.least(F.greatest(F.col("target") / (most * F.greatest(F.col("source_size"), F.lit(1))), F.lit(1e-9)), F.lit(1 - 1e-9))
    begin = F.when(full, 0.0).otherwise(F.ln(share / (1 - share)) + math.log(most - 1))
    state = cut(goals.select("source", "source_size", "target", "scale", full.alias("full"), begin.alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), (full | (F.col("source_size") == 0)).alias("done")))
    for _ in range(rounds):
        open_ = state.filter(~F.col("done"))
        # null-safe: a null source is one like any other
        both = sizes.join(open_.select(F.col("source").alias("_s"), "lam", "scale"), F.col("source").eqNullSafe(F.col("_s")))
        x = F.col("size") / F.col("scale")
        rate = tilt(F.col("lam"), x, most)
        sums = both.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("n") * F.col("size") * rate).alias("_got"), F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / most)).alias("_slope"))
        s = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        over = F.col("_got") - F.col("target")
        lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - over / F.greatest(F.col("_slope"), F.lit(1e-30))
        inside = (step > lo) & (step < hi)
        middle = F.when((hi > 1e5) & (lo >= 0), 2 * F.col("lam") + 1).when((lo < -1e5) & (hi <= 0), 2 * F.col("lam") - 1).otherwise((lo + hi) / 2)
        reached = F.abs(over) <= close * F.greatest(F.col("target"), F.lit(1.0))
        live = ~F.col("done") & F.col("_got").isNotNull() & ~reached
        state = cut(
            s.select(
                "source", "source_size", "target", "scale", "full",
                F.when(live, F.when(inside & (F.abs(step - F.col("lam")) < 4 + F.abs(F.col("lam"))), step).otherwise(middle)).otherwise(F.col("lam")).alias("lam"),
                F.when(live, lo).otherwise(F.col("lo")).alias("lo"), F.when(live, hi).otherwise(F.col("hi")).alias("hi"), (~live).alias("done"),
            )
        )
        if state.filter(~F.col("done")).isEmpty():
            # so that the order of sums decides nothing
            return state.select("source", "source_size", "target", "scale", "full", F.round("lam", 10).alias("lam"))
    raise RuntimeError(f"rates have not converged after {rounds} rounds")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None, text: str = "text", weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: int = 2, fills: int = 3) -> DataFrame:
    """(key, size, source, source_size, target, rate, copies, taken) of every document."""
    if most < 2:
        raise ValueError("most: 2 at least")
    slim = cut(docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), (count_words(F.col(text)) if size is None else size).alias("size")))
    sizes = cut(slim.groupBy("source", "size").agg(F.count("*").alias("n")))
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.col("size") * F.col("size") * F.col("n")).alias("_sq"))
    scales = by_source.select(F.col("source").alias("_s"), (F.when(F.col("source_size") > 0, F.col("_sq") / F.col("source_size")).otherwise(1.0)).alias("scale"))
    goals = targets(by_source.select("source", "source_size"), weights, budget, most).join(scales, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    solved = solve(sizes, goals, most).withColumnRenamed("source", "_s")

    rate = F.when(F.col("full"), F.lit(float(most))).otherwise(tilt(F.col("lam"), F.col("size") / F.col("scale"), most))
    u = F.pmod(F.xxhash64(F.lit(7), F.col("_key"), F.col("size")), F.lit(1 << 40)) / float(1 << 40)
    rows = slim.join(solved, F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", rate)
    base = F.least(F.floor(F.col("rate") + u - 0.5), F.lit(most)).cast("long")
    # where between 0 and 1 a rising delta gives the document one more copy; -1: never
    turn = F.when((base >= most) | (base < 0), F.lit(-1.0)).otherwise(1 - (F.col("rate") + u - 0.5 - base))
    rows = cut(rows.select("_key", "source", "size", "source_size", "target", "rate", F.greatest(base, F.lit(0)).alias("base"), turn.alias("turn")))
    cutoff = thresholds(rows)
    joined = rows.join(cutoff.select(F.col("source").alias("_s"), "limit"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    extra = F.when((F.col("turn") >= 0) & (F.col("turn") < F.coalesce(F.col("limit"), F.lit(0.0))) & (F.col("base") < most), 1).otherwise(0)
    taken = cut(joined.select("_key", "source", "size", "source_size", "target", "rate", (F.col("base") + extra).alias("copies")))
    taken = filled(taken, most, fills)
    return taken.select(F.col("_key").alias(key), "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def thresholds(rows: DataFrame, passes: int = 2) -> DataFrame:
    """(source, limit): the largest limit for which base copies and the turns below it stay within the target."""
    used = F.sum(F.col("base") * F.col("size"))
    state = rows.groupBy("source").agg(F.first("target").alias("target"), used.alias("_used")).withColumn("limit", F.lit(0.0))
    state = cut(state)
    width = 1.0
    for _ in range(passes):
        width /= BINS
        at = rows.filter((F.col("turn") >= 0) & (F.col("size") > 0)).join(state.select(F.col("source").alias("_s"), "limit"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        near = at.filter((F.col("turn") >= F.col("limit")) & (F.col("turn") < F.col("limit") + BINS * width))
        bins = near.groupBy("source", F.floor((F.col("turn") - F.col("limit")) / width).alias("bin")).agg(F.sum("size").alias("tokens"))
        run = bins.withColumn("_sum", F.sum("tokens").over(W.partitionBy("source").orderBy("bin")))
        s = run.join(state.select(F.col("source").alias("_s"), "target", "_used"), F.col("source").eqNullSafe(F.col("_s")))
        whole = s.groupBy("_s").agg(
            F.max(F.when(F.col("_used") + F.col("_sum") <= F.col("target"), F.col("_sum"))).alias("_add"),
            F.min(F.when(F.col("_used") + F.col("_sum") > F.col("target"), F.col("bin"))).alias("_stop"),
        )
        j = state.join(whole, F.col("source").eqNullSafe(F.col("_s")), "left")
        state = cut(j.select("source", "target", (F.col("_used") + F.coalesce(F.col("_add"), F.lit(0))).alias("_used"), (F.col("limit") + width * F.coalesce(F.col("_stop"), F.lit(BINS))).alias("limit")))
    return state


def filled(taken: DataFrame, most: int, fills: int) -> DataFrame:
    """taken with one more copy, `fills` times over, of the largest document of each source that still fits.

    A row for each source is kept from pass to pass; the documents are read, not rewritten.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    left = taken.groupBy(F.col("source").alias("_s")).agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("_left"))
    open_ = taken.filter((F.col("copies") < most) & (F.col("size") > 0)).select("_key", "source", "size", F.xxhash64("_key").alias("_h"))
    picked = None
    for _ in range(fills):
        room = open_.join(left, same("source", "_s")).filter(F.col("size") <= F.col("_left")).drop("_s")
        if picked is not None:
            p = picked.select(F.col("source").alias("_ps"), F.col("_key").alias("_pk"), F.col("size").alias("_pz"))
            room = room.join(p, same("source", "_ps") & same("_key", "_pk") & same("size", "_pz"), "left_anti")
        best = room.groupBy("source", "_left").agg(F.max(F.struct("size", "_h", "_key")).alias("_b"))
        best = cut(best.select("source", "_b._key", "_b.size", (F.col("_left") - F.col("_b.size")).alias("_left")))
        picked = best.select("source", "_key", "size") if picked is None else picked.union(best.select("source", "_key", "size"))
        left = best.select(F.col("source").alias("_s"), "_left")
    if picked is None:
        return taken
    p = picked.groupBy(F.col("source").alias("_ps"), F.col("_key").alias("_pk"), F.col("size").alias("_pz")).agg(F.count("*").alias("_n"))
    more = taken.join(p, same("source", "_ps") & same("_key", "_pk") & same("size", "_pz"), "left")
    return more.withColumn("copies", F.least(F.col("copies") + F.coalesce("_n", F.lit(0)), F.lit(most))).drop("_ps", "_pk", "_pz", "_n")

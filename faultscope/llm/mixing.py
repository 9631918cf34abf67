"""Mixing sources to target weights by entropy balancing.

Documents get rates w = min(limit, exp(a * size)) with one multiplier a per source:
of all rates whose tokens meet the source's target, these are nearest to taking every
document once (relative entropy, rates bounded by ``limit``). The multiplier is the
root of the convex dual's gradient, ``sum(w * size) - target``; all sources are solved
at once by Newton steps, each a distributed sum over (source, size) counts, kept inside
a bracket. Rates are then rounded into whole copies by carrying the token error on
within groups of bounded size, so a source misses its target by about one short
document per group. Everything depends on ids, sizes and sources only; reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.llm.common import word_count
from faultscope.staging import stage

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3
GROUP = 4_096
STEPS = 40
PRECISION = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target, docs: the share of all tokens each source is to give.

    Sources by code point, null last, take ``weights`` in turn and share the sum of all
    sizes; a target stops at ``limit`` times its source's size and the excess is shared
    among the others by weight, until none is above. The table has one row per source.
    The sharing is solved at once: sources stop in the order of size / weight, so a
    running sum over that order shows which ones stop.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    ranked = (by.withColumn("weight", weight)
              .withColumn("total", F.sum("source_size").over(everything))
              .withColumn("left_size", F.col("total") - limit * F.coalesce(F.sum("source_size").over(before), zero))
              .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)))
    share = F.col("left_size") / F.col("left_weight")
    ranked = ranked.withColumn("stops", F.col("weight") * share > limit * F.col("source_size"))
    # The first source that doesn't stop fixes the share of all that follow.
    free = F.first(F.when(~F.col("stops"), share), ignorenulls=True).over(everything)
    target = F.when(F.col("stops"), (limit * F.col("source_size")).cast("double")).otherwise(F.col("weight") * free)
    return ranked.select("source", F.col("source_size").cast("long").alias("source_size"), F.coalesce(target, F.lit(0.0)).alias("target"), "docs")


def _rate(a: Column, x: Column, limit: int) -> Column:
    return F.least(F.lit(float(limit)), F.exp(F.least(a * x, F.lit(50.0))))


def solve_rates(counts: DataFrame, targets: DataFrame, limit: int = LIMIT, steps: int = STEPS, precision: float = PRECISION) -> DataFrame:
    """source, scale, a: rates are ``min(limit, exp(a * size / scale))``.

    ``counts`` has (source, size, n). One job a step sums tokens and their derivative per
    source; a step outside the bracket, or that a flat sum would throw far, halves it.
    """
    start = targets.where("source_size > 0 and target > 0").select(
        "source", "target", (F.col("source_size") / F.col("docs")).alias("scale"),
        F.lit(0.0).alias("a"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"), F.lit(False).alias("done"))
    state = stage(start, "dual")
    for _ in range(steps):
        x = F.col("size") / F.col("scale")
        moved = counts.join(state, counts["source"].eqNullSafe(state["source"])).select(
            state["source"], "target", "scale", "a", "low", "high",
            (F.col("n") * F.col("size") * _rate(F.col("a"), x, limit)).alias("tokens"),
            F.when(F.col("a") * x < float(np.log(limit)), F.col("n") * F.col("size") * x * _rate(F.col("a"), x, limit)).otherwise(0.0).alias("slope"))
        sums = moved.groupBy("source", "target", "scale", "a", "low", "high").agg(F.sum("tokens").alias("tokens"), F.sum("slope").alias("slope"))
        gap = F.col("tokens") - F.col("target")
        low, high = F.when(gap < 0, F.col("a")).otherwise(F.col("low")), F.when(gap > 0, F.col("a")).otherwise(F.col("high"))
        step = F.when(F.col("slope") > 0, F.col("a") - gap / F.col("slope"))
        middle = (F.col("low") + F.col("high")) / 2
        done = F.abs(gap) <= precision * F.col("target")
        nxt = (sums.withColumn("low", low).withColumn("high", high).withColumn("step", step).withColumn("done", done)
               .withColumn("a", F.when(F.col("done"), F.col("a")).when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step")).otherwise(middle)))
        state = stage(nxt.select("source", "target", "scale", "a", "low", "high", "done"), "dual")
        if state.where("not done").isEmpty():
            break
    return state.select("source", "scale", "a")


def carried_copies(size: np.ndarray, rate: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Whole copies of each document, the token error carried from one to the next.

    Every document takes the floor or the ceiling of its rate, whichever brings the
    running error nearer to zero. Longest first, so that short ones settle the rest.
    """
    copies = np.zeros(len(size), np.int64)
    error = 0.0
    for k, (s, r) in enumerate(zip(size.tolist(), rate.tolist())):
        low = min(limit, int(r))
        high = min(limit, low + 1) if r > low else low
        want = error + s * r
        copies[k] = low if abs(want - s * low) <= abs(want - s * high) else high
        error = want - s * int(copies[k])
    return copies


def mix_documents(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """Copies per row of (doc_id, source, size): adds source_size, target, rate, copies, taken.

    A row of size 0 takes no copy. Groups of about ``group`` documents, dealt by a hash of
    the id within a source, are rounded apart from each other. Rows that repeat an id
    count one by one. An empty table gives an empty result.
    """
    sizes = stage(sizes.select("doc_id", "source", F.col("size").cast("long").alias("size")), "sizes")
    targets = stage(source_targets(sizes, weights, limit), "targets")
    counts = stage(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    rates = solve_rates(counts, targets, limit)
    plan = stage(targets.join(rates.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
                 .select(F.col("source").alias("__source"), "source_size", "target", "scale", "a",
                         F.ceil(F.col("docs") / group).cast("int").alias("groups")), "mix-plan")
    rated = sizes.join(plan, F.col("source").eqNullSafe(F.col("__source"))).select(
        "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, _rate(F.coalesce("a", F.lit(0.0)), F.col("size") / F.col("scale"), limit) * F.when(F.col("a").isNull(), 0.0).otherwise(1.0)).otherwise(0.0).alias("rate"),
        F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "size"), F.col("groups").cast("long")).cast("int").alias("part"))

    def copies(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
        pdf["copies"] = carried_copies(pdf["size"].to_numpy(), pdf["rate"].to_numpy(), limit)
        pdf["taken"] = pdf["copies"] * pdf["size"]
        return pdf[["doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken"]]

    kind = sizes.schema["doc_id"].dataType.simpleString()
    return rated.groupBy("source", "part").applyInPandas(
        copies, f"doc_id {kind}, source string, size long, source_size long, target double, rate double, copies long, taken long")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``mix_documents`` over a table of documents, whose size is the number of words.

    A null text has size 0; a null source is a source of its own, after all others.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    return mix_documents(sizes, weights, limit)

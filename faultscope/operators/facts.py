"""Raw facts to numbered facts: block context, ids, citations, sentences."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.families import FAMILIES
from faultscope.families import profile
from faultscope.families.base import Family, sentence
from faultscope.functions.sql import literal
from faultscope.schema import FACTS, KEY


def citation(artifact: Column, anchor: Column) -> Column:
    """``artifact:anchor``: a line number, ``events[i]``, ``summary`` or ``op:name``."""
    return F.concat_ws(":", artifact, anchor.cast("string"))


def summary_text(families: Sequence[Family] | None = None) -> Column:
    """The sentence of a fact, from its ``family``, ``kind`` and ``data``."""
    tables = {f.name: f.summaries for f in families} if families else {**{f.name: f.summaries for f in FAMILIES.values()}, profile.NAME: profile.SUMMARIES}
    branches = []
    for name, sentences in tables.items():
        inner = " ".join(f"when {literal(k)} then {sentence(t, 'data')}" for k, t in sentences.items())
        branches.append(f"when {literal(name)} then case kind {inner} end")
    return F.expr(f"case family {' '.join(branches)} end")


def as_facts(df: DataFrame, anchor: Column, families: Sequence[Family] | None = None) -> DataFrame:
    """Put numbered rows into the facts schema."""
    return df.select(
        *KEY, F.col("seq").cast("bigint").alias("seq"), F.concat(F.lit("f"), F.col("seq")).alias("id"), "kind",
        summary_text(families).alias("summary"),
        citation(F.col("artifact"), anchor).alias("source"), "excerpt", "data")


def _context(families: Sequence[Family], of) -> Column:
    """A column that differs per family with block context, null elsewhere."""
    out = F.lit(None)
    for f in families:
        if f.context:
            out = F.when(F.col("family") == f.name, of(f.context)).otherwise(out)
    return out


def resolve_facts(raw: DataFrame, families: Sequence[Family] | None = None) -> DataFrame:
    """Line facts with their block's context and their number.

    Context and numbering share one sliced pass: a slice knows its own last
    heading and how many of its facts hang on a heading of an earlier slice;
    both travel in one frame row per slice. ``raw`` is read twice, so stage it.
    ``families`` are those of the package unless given.
    """
    families = families or list(FAMILIES.values())
    opened = _context(families, lambda c: F.when(F.col("kind").isin(*c.opens), F.col("data")[c.key]))
    hangs = F.coalesce(_context(families, lambda c: F.col("kind").isin(*c.takes) if c.required else F.lit(False)), F.lit(False))
    parts = [*KEY, "slice"]
    here = Window.partitionBy(*parts).orderBy("lineno", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*KEY).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)

    local = (raw.withColumn("_opened", opened)
             .withColumn("_here", F.last("_opened", ignorenulls=True).over(here))
             .withColumn("_held", (hangs & F.col("_here").isNull()).cast("bigint"))
             .withColumn("_sure_n", F.sum(1 - F.col("_held")).over(here))
             .withColumn("_held_n", F.sum("_held").over(here)))
    frames = (local.groupBy(*parts)
              .agg(F.max("_sure_n").alias("_sure_all"), F.max("_held_n").alias("_held_all"),
                   F.max_by("_here", "lineno").alias("_tail"))
              .withColumn("_carry", F.last("_tail", ignorenulls=True).over(before))
              .withColumn("_n", F.col("_sure_all")
                          + F.when(F.col("_carry").isNotNull(), F.col("_held_all")).otherwise(0))
              .select(*parts, "_carry", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    carried = F.col("_carry").isNotNull()
    context = F.coalesce("_here", "_carry")
    takes = F.coalesce(_context(families, lambda c: F.lit(True) if c.takes is None else F.col("kind").isin(*c.takes)), F.lit(False))

    def with_context(key: str) -> Column:
        return F.when(takes & context.isNotNull() & ~F.map_contains_key("data", key),
                      F.map_concat("data", F.create_map(F.lit(key), context))).otherwise(F.col("data"))

    data = F.col("data")
    for f in families:
        if f.context:
            data = F.when(F.col("family") == f.name, with_context(f.context.key)).otherwise(data)
    return (local.join(frames, parts)
            .where((F.col("_held") == 0) | carried)
            .withColumn("seq", F.col("_before") + F.col("_sure_n") + F.when(carried, F.col("_held_n")).otherwise(0))
            .select(*KEY, "seq", "lineno", "ordinal", "kind", "excerpt", data.alias("data")))


def number_facts(resolved: DataFrame, families: Sequence[Family] | None = None) -> DataFrame:
    """Resolved line facts in the facts schema."""
    return as_facts(resolved, F.col("lineno"), families).select(*FACTS.fieldNames())

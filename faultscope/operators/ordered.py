"""Ordered work on groups of any size.

A window over one artifact puts all of its rows into one task. Here a group is
cut into slices: the window runs per slice, a frame row per slice carries what
the next slice needs, and only the frame rows meet per group. One artifact that
holds a third of all rows is then spread over the cluster like any other.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.staging import stage

# Rows of a group that one task handles at a time.
SLICE = 65_536


def number_within(df: DataFrame, keys: list[str], slices: list[str], order: list[Column | str],
                  out: str) -> DataFrame:
    """Row numbers 1, 2, … within ``keys`` in the order of ``slices``, then ``order``.

    Keys and slices must not be null. Two passes over ``df``: hand in something
    cheap to read (a staged table), not a plan that parses text.
    """
    parts = [*keys, *slices]
    here = Window.partitionBy(*parts).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    frames = (df.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
              .select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (df.withColumn("_rank", F.row_number().over(here))
            .join(frames, parts)
            .withColumn(out, F.col("_before") + F.col("_rank"))
            .drop("_before", "_rank"))


def carry_last(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
               size: int = SLICE) -> DataFrame:
    """Forward fill: the last non-null ``value`` up to and including each row."""
    df = df.withColumn("_value", value).withColumn("_slice", F.floor(F.col(order) / size))
    parts = [*keys, "_slice"]
    here = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (df.groupBy(*parts)
               .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_tail"))
               .select(*parts, F.last("_tail", ignorenulls=True).over(before).alias("_carry")))
    return (df.withColumn("_here", F.last("_value", ignorenulls=True).over(here))
            .join(carried, parts)
            .withColumn(out, F.coalesce("_here", "_carry"))
            .drop("_value", "_slice", "_here", "_carry"))


def running_count(df: DataFrame, keys: list[str], order: str, counted: str, out: str, bits: int = 16) -> DataFrame:
    """Sum of ``counted`` over the rows of ``keys`` up to and including each row, in ``order``.

    The whole table is sorted once by ranges and cut every 2**bits places, so a key that
    holds most rows is spread over many tasks. Keys must not be null and rows of a key
    must differ in ``order``.
    """
    place = [*keys, order]
    placed = stage(df.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("_pos", F.monotonically_increasing_id()), "ordered")
    parts = [*keys, "_slice"]
    placed = placed.withColumn("_slice", F.shiftright("_pos", bits))
    here = Window.partitionBy(*parts).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    frames = (placed.groupBy(*parts).agg(F.sum(counted).alias("_n"))
              .select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (placed.withColumn("_here", F.sum(counted).over(here)).join(frames, parts)
            .withColumn(out, F.col("_before") + F.col("_here")).drop("_before", "_here", "_slice", "_pos"))

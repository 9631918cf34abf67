"""Comparison of hosts and of runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.functions.hosts import classify_host
from faultscope.functions.numbers import div
from faultscope.operators.ordered import SLICE, number_within

# Host pairs grow with the square of the hosts of one model, so the smaller
# side is spread over this many parts before the join.
SALT = 16

# What runs must share to be compared.
PAIRED = ["model", "variant", "inputs"]


def classify_hosts(hosts: DataFrame) -> DataFrame:
    """Host rows with their capability verdict (yes, no, or null for unknown)."""
    return hosts.withColumn("c", classify_host(F.col("machine"), F.col("flags"))).select(*hosts.columns, "c.*")


def baseline_pairs(baselines: DataFrame, runs: DataFrame, verdicts: DataFrame, salt: int = SALT) -> DataFrame:
    """Runs against baselines of *other* hosts, per model, variant and inputs.

    ``baselines`` and ``runs`` hold ``(host, model, variant, inputs, output)``; a
    baseline counts only when its host is certainly suitable. The keys may be
    skewed (one model on most hosts), so runs are salted and baselines repeated.
    """
    keys = ["model", "variant", "inputs"]
    suitable = verdicts.where("suitable").select("host")
    left = (baselines.join(suitable, "host", "left_semi")
            .select(*keys, F.col("host").alias("baseline_host"), F.col("output").alias("baseline_output"),
                    F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("salt")))
    right = runs.select(*keys, "host", "output", F.pmod(F.xxhash64("host", *keys), F.lit(salt)).cast("int").alias("salt"))
    return (right.join(left, [*keys, "salt"]).where(F.col("host") != F.col("baseline_host"))
            .select(*keys, "host", "baseline_host", "output", "baseline_output"))


def output_classes(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``(model, variant, inputs, output, hosts, baselines)``: runs of ``(host, model, variant, inputs,
    output)`` with equal outputs as one class.

    ``hosts`` counts the hosts that gave the output, ``baselines`` the suitable ones among
    them. Runs that a host repeats with the same output count once. What the class of each
    host is remains in ``runs``: class and membership are all pairs, without a pair row.
    """
    suitable = verdicts.where("suitable").select("host").distinct().withColumn("_suits", F.lit(1))
    one = runs.select(*PAIRED, "output", "host").distinct().join(suitable, "host", "left")
    return one.groupBy(*PAIRED, "output").agg(F.count(F.lit(1)).alias("hosts"), F.count("_suits").alias("baselines"))


def class_agreement(classes: DataFrame) -> DataFrame:
    """``(model, variant, inputs, classes, hosts, baselines, pairs, agree, differ)`` from class sizes.

    ``pairs`` counts every host against every suitable host but itself; ``agree`` those of
    one class. A model with n hosts takes as many rows as it has different outputs.
    """
    totals = classes.groupBy(*PAIRED).agg(
        F.count(F.lit(1)).alias("classes"), F.sum("hosts").alias("hosts"), F.sum("baselines").alias("baselines"),
        F.sum(F.col("hosts") * F.col("baselines") - F.col("baselines")).alias("agree"))
    pairs = F.col("hosts") * F.col("baselines") - F.col("baselines")
    return totals.withColumn("pairs", pairs).withColumn("differ", F.col("pairs") - F.col("agree"))


def class_pairs(classes: DataFrame) -> DataFrame:
    """``(model, variant, inputs, output, baseline_output, pairs, representative, baseline_representative)``: which
    outputs stand against which, with the number of host pairs behind each.

    Only classes are paired, one row for two different outputs; their hosts are found by the
    output. ``classes`` may carry ``representative`` (see ``with_representatives``).
    """
    left = classes.where("hosts > 0")
    right = classes.where("baselines > 0").select(*PAIRED, F.col("output").alias("baseline_output"), F.col("baselines").alias("_baselines"),
                                                  F.col("baseline_representative"))
    same = F.col("output") == F.col("baseline_output")
    pairs = F.col("hosts") * F.col("_baselines") - F.when(same, F.col("_baselines")).otherwise(0)
    return (left.drop("baseline_representative").join(right, PAIRED).withColumn("pairs", pairs).where("pairs > 0")
            .select(*PAIRED, "output", "baseline_output", "pairs", "representative", "baseline_representative"))


def with_representatives(classes: DataFrame, runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds the least host of each class and its least suitable one."""
    suits = verdicts.where("suitable").select("host").distinct().withColumn("_suits", F.lit(True))
    least = runs.join(suits, "host", "left").groupBy(*PAIRED, "output").agg(
        F.min("host").alias("representative"), F.min(F.when(F.col("_suits"), F.col("host"))).alias("baseline_representative"))
    return classes.join(least, [*PAIRED, "output"])


def run_pair_invariance(facts: DataFrame, pairs: DataFrame, verdict_kinds: list[str], slice_rows: int = SLICE) -> DataFrame:
    """``(left, right, kind, same, differ, verdict)`` for pairs of runs: per kind how many
    facts carry equal payloads and how many do not, facts paired by their place
    within the kind. A kind that only one run has differs throughout."""
    placed = number_within(
        facts.select("artifact", "kind", "seq", div(F.col("seq") - 1, slice_rows).alias("slice"),
                     F.to_json(F.map_from_entries(F.array_sort(F.map_entries("data")))).alias("payload")),
        ["artifact", "kind"], ["slice"], ["seq"], "place").select("artifact", "kind", "place", "payload")
    a = pairs.join(placed.withColumnRenamed("artifact", "left"), "left").select("left", "right", "kind", "place", F.col("payload").alias("pa"))
    b = pairs.join(placed.withColumnRenamed("artifact", "right"), "right").select("left", "right", "kind", "place", F.col("payload").alias("pb"))
    same = F.col("pa").eqNullSafe(F.col("pb"))
    return (a.join(b, ["left", "right", "kind", "place"], "full").groupBy("left", "right", "kind")
            .agg(F.count_if(same).alias("same"), F.count_if(~same).alias("differ"))
            .withColumn("verdict", F.col("kind").isin(verdict_kinds)))

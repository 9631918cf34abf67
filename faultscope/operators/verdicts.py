"""One row per artifact: counts and verdict."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.operators.rules import SEVERITIES
from faultscope.schema import KEY


def summary_counts(artifacts: DataFrame, diagnoses: DataFrame, facts: DataFrame) -> DataFrame:
    """``errors, warnings, infos, other, facts`` of every artifact, also of clean ones."""
    error, warning, info = SEVERITIES
    severity = F.col("severity")
    by_diagnosis = diagnoses.groupBy(*KEY).agg(
        F.count_if(severity == error).alias("errors"), F.count_if(severity == warning).alias("warnings"),
        F.count_if(severity == info).alias("infos"), F.count_if(~severity.isin(*SEVERITIES)).alias("other"))
    by_fact = facts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("facts"))
    counts = ["errors", "warnings", "infos", "other", "facts"]
    return (artifacts.select(*KEY).distinct().join(by_diagnosis, KEY, "left").join(by_fact, KEY, "left")
            .fillna(0, counts).select(*KEY, *counts))


def verdicts(artifacts: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """``exit_code``: 2 for an error of a rule; else 3 for a warning of a rule or any
    synthesized finding; else 0. A synthesized finding can never give 2."""
    ruled = F.col("origin") == "rules"
    per = diagnoses.groupBy(*KEY).agg(
        F.bool_or(ruled & (F.col("severity") == "error")).alias("e"),
        F.bool_or((ruled & (F.col("severity") == "warning")) | ~ruled).alias("w"))
    return (artifacts.select(*KEY).distinct().join(per, KEY, "left")
            .select(*KEY, F.when(F.col("e"), 2).when(F.col("w"), 3).otherwise(0).alias("exit_code")))

"""Facts documents."""

from pyspark.sql import DataFrame, SparkSession

from faultscope.schema import FACTS


def write_facts_json(facts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Facts as JSON lines."""
    facts.select(*FACTS.fieldNames()).write.mode(mode).json(path, ignoreNullFields=True)


def read_facts_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same contract back, with a fixed schema: no inference pass."""
    return spark.read.schema(FACTS).json(path)

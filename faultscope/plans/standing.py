"""Verdicts that are kept up to date while facts arrive in batches, in any order.

What rule matching asks about an artifact merges: masks by bitwise or, the number of its
facts by maximum, the first fact of a kind by minimum. So a stored row per artifact (and
kind) takes a batch in without the facts before it, and taking the same batch twice changes
nothing. Only artifacts whose row a batch changes are matched again.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.operators.rules import artifact_profile, match_rules
from faultscope.operators.verdicts import verdicts
from faultscope.schema import KEY
from faultscope.sources.rulebook import Rulebook

_WORDS = T.ArrayType(T.LongType())
_KEYS = [T.StructField(k, T.StringType()) for k in KEY]
STATE = T.StructType([*_KEYS, T.StructField("kinds", _WORDS), T.StructField("met", _WORDS), T.StructField("facts", T.LongType())])
FIRSTS = T.StructType([*_KEYS, T.StructField("kind", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("id", T.StringType()), T.StructField("source", T.StringType())])
VERDICTS = T.StructType([*_KEYS, T.StructField("exit_code", T.IntegerType())])
RUNS = T.StructType([T.StructField("version", T.LongType()), T.StructField("book", T.StringType()), T.StructField("matched", T.LongType())])


def merge_profiles(parts: DataFrame, words: int) -> DataFrame:
    """Profiles of the same artifacts into one row each."""
    each = [(c, w) for c in ("kinds", "met") for w in range(words)]
    merged = parts.groupBy(*KEY).agg(*[F.bit_or(F.coalesce(F.get(c, F.lit(w)), F.lit(0).cast("bigint"))).alias(f"{c}{w}") for c, w in each], F.max("facts").alias("facts"))
    return merged.select(*KEY, *[F.array(*[f"{c}{w}" for w in range(words)]).alias(c) for c in ("kinds", "met")], F.coalesce("facts", F.lit(0).cast("bigint")).alias("facts"))


def merge_firsts(parts: DataFrame) -> DataFrame:
    """The first fact of every kind of an artifact."""
    return parts.groupBy(*KEY, "kind").agg(F.min(F.struct("seq", "id", "source")).alias("f")).select(*KEY, "kind", "f.*")


class Standing:
    """The tables ``state``, ``firsts`` and ``verdicts`` in a folder, a version per batch.

    A version is complete before ``runs`` names it, so a batch that fails leaves the one
    before it in force. The masks belong to one rule book; another needs a folder of its own.
    """

    def __init__(self, spark: SparkSession, folder: str, book: Rulebook | None = None):
        self.spark, self.folder, self.book = spark, folder.rstrip("/"), book or Rulebook.builtin()
        self.mark = hashlib.sha256(json.dumps(self.book.rules, sort_keys=True).encode()).hexdigest()

    def _runs(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/runs")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(RUNS).parquet(f"{self.folder}/runs") if there else self.spark.createDataFrame([], RUNS)

    def version(self) -> int:
        """Number of the last complete version, 0 before the first batch."""
        last = self._runs().orderBy(F.desc("version")).first()
        if last is not None and last["book"] != self.mark:
            raise ValueError("these tables were made with other rules")
        return 0 if last is None else last["version"]

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        version = self.version()
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{version}") if version else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, version: int, schema: T.StructType) -> DataFrame:
        df.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("overwrite").parquet(f"{self.folder}/{name}/{version}")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{version}")

    def state(self) -> DataFrame:
        return self._read("state", STATE)

    def firsts(self) -> DataFrame:
        """``(family, artifact, kind, seq, id, source)``: the first fact of every kind so far."""
        return self._read("firsts", FIRSTS)

    def verdicts(self) -> DataFrame:
        """``(family, artifact, exit_code)`` of every artifact that a batch has named."""
        return self._read("verdicts", VERDICTS)

    def add(self, facts: DataFrame, artifacts: DataFrame | None = None) -> int:
        """Take a batch in; gives the number of artifacts matched again. ``facts`` are read
        several times, so hand in a stored table; ``artifacts`` also names those without facts."""
        version, old, known = self.version() + 1, self.state(), self.verdicts()
        names = facts.select(*KEY) if artifacts is None else artifacts.select(*KEY).unionByName(facts.select(*KEY))
        none = [F.array().cast(_WORDS).alias("kinds"), F.array().cast(_WORDS).alias("met"), F.lit(0).cast("bigint").alias("facts")]
        batch = artifact_profile(facts, self.book).unionByName(names.distinct().select(*KEY, *none))
        state = self._write(merge_profiles(old.unionByName(batch), self.book.words), "state", version, STATE)
        self._write(merge_firsts(self.firsts().unionByName(facts.select(*KEY, "kind", "seq", "id", "source"))), "firsts", version, FIRSTS)
        # What matching reads: a changed number of facts alone changes no verdict.
        before = old.select(*KEY, F.struct("kinds", "met").alias("before"))
        again = (state.join(before, KEY, "left").where(~F.struct("kinds", "met").eqNullSafe(F.col("before"))).drop("before"))
        again = self._write(again, "again", version, STATE)
        fired = match_rules(again, self.book).withColumn("origin", F.lit("rules"))
        self._write(known.join(again.select(*KEY), KEY, "left_anti").unionByName(verdicts(again, fired).select(*VERDICTS.fieldNames())), "verdicts", version, VERDICTS)
        matched = again.count()
        self.spark.createDataFrame([(version, self.mark, matched)], RUNS).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")
        return matched

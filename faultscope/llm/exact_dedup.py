"""Exact dedup: a tree that merges sorted runs of digests.

Every partition of the table starts as one run: its rows sorted and reduced by digest.
In each round, runs whose numbers agree but for the last digits exchange their rows by
digest and are merged, ``fan_in`` runs into one, keeping of each digest the best row and
the number of rows, until one run, spread over all tasks by digest, is left. Copies
collapse inside their run before anything moves, so a group that holds a third of all
rows reaches a merge as one row per run. A digest is verified by a second hash and the
length of the normalised text, which travel with it as part of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import SPACES, texts_of
from faultscope.staging import stage

KEY = ["sha", "check", "norm_len"]


def normalised(text: Column) -> Column:
    """A text without its white space."""
    return F.translate(text, SPACES, "")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, digest of the normalised text, what verifies it, code points and a row tag."""
    norm = texts_of(docs, id_col, text_col).select("doc_id", F.length("text").cast("long").alias("size"), normalised(F.col("text")).alias("norm"))
    return norm.select("doc_id", "size", F.unhex(F.sha2("norm", 256)).alias("sha"), F.xxhash64("norm").alias("check"),
                       F.length("norm").alias("norm_len"), F.monotonically_increasing_id().alias("row"))


def merge_runs(rows: DataFrame, runs: int, fan_in: int = 16) -> DataFrame:
    """Best row and number of rows per digest, by rounds of ``fan_in``-way merges.

    ``row >> 33`` is the partition that a row came from, hence its run.
    """
    bits = fan_in.bit_length() - 1
    run = F.shiftrightunsigned("row", 33)
    # Smallest wins: most code points, ids before nulls, smallest id, first row.
    best = F.struct((-F.col("size")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    level = rows.select(*KEY, run.alias("run"), best.alias("best"), F.lit(1).cast("long").alias("n"))
    while True:
        level = (level.withColumn("run", F.shiftrightunsigned("run", bits)).groupBy(*KEY, "run")
                 .agg(F.min("best").alias("best"), F.sum("n").alias("n")))
        runs = -(-runs // fan_in)
        if runs <= 1:
            return level.drop("run")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after white space is deleted. Of equal texts the
    longest original stays, then the smallest doc_id. A null text is empty; all empty
    texts are one group. A null doc_id comes after every other id; of rows that repeat
    with the same id and length exactly one has ``kept``. Other columns are not read.
    An empty table gives an empty result.
    """
    rows = stage(digest_rows(docs, id_col, text_col), "digests")
    runs = (rows.agg(F.max(F.shiftrightunsigned("row", 33))).first()[0] or 0) + 1
    groups = stage(merge_runs(rows, runs, fan_in).where("n > 1")
                   .select(*KEY, "n", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups")
    # A text of its own needs no partner. Large groups are split by the skew join.
    found = rows.join(groups, KEY, "left")
    alone = F.col("keep_row").isNull()
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))

"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, source mixing, BPE.

Each stage works on all rows that its predecessor kept and returns the columns of
``documents``, the last one tokens. A stage looks at its input alone (the rules also
read ``labels``), so each can be run and judged by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from faultscope.llm.common import with_copies
from faultscope.llm.queries import table, tokenizer_file
from faultscope.staging import stage

#: Trained rules, fingerprints and rounding are beyond SQL.
ORACLE_SQL = None


def _longest_first(docs: DataFrame) -> tuple:
    return F.length("text").desc_nulls_last(), F.col("text"), F.col("source"), F.col("lang")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trained verdict."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of texts equal but for white space."""
    found = exact_dedup.exact_duplicates(docs)
    decided = found.select("doc_id", F.col("kept").cast("int").alias("copies"), F.col("text_sha256").alias("key"))
    sha = F.sha2(exact_dedup.normalised(F.coalesce(docs["text"], F.lit(""))), 256)
    return with_copies(docs, decided, key=sha, order=_longest_first(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the one of the smallest doc_id."""
    decided = simhash.near_duplicates(docs).select("doc_id", F.col("kept").cast("int").alias("copies"), "key")
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return with_copies(docs, decided, key=key, order=_longest_first(docs), once=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix of sources takes."""
    taken = mixing.mixture(docs)
    return with_copies(docs, taken.select("doc_id", "copies"), order=_longest_first(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hashes of ids and decoded text of every copy."""
    return bpe.round_trip(docs, tokenizer_file("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("simhash_near_dedup", near), ("source_mixing", mixed), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

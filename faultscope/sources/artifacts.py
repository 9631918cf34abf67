"""Artifacts and lines."""

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultscope.functions.text import LINE_BREAK, split_lines
from faultscope.staging import stage


def list_artifacts(spark: SparkSession, paths: str | list[str], family: str) -> DataFrame:
    """``(family, artifact)`` of all files, empty ones too; no content is read.

    Spark's scans leave out files of no length, so the names come from its file index,
    which the driver holds for every scan anyway.
    """
    files = spark.read.format("binaryFile").load(paths).inputFiles()
    return spark.createDataFrame([(family, unquote(f).rpartition("/")[2]) for f in files], "family string, artifact string")


def read_artifacts(spark: SparkSession, paths: str | list[str], family: str) -> DataFrame:
    """Whole text files as ``(family, artifact, text)``, an empty file with the empty text.
    Bytes that are no UTF-8 become U+FFFD; the artifact is named by its file name alone."""
    name = F.col("_metadata.file_name").alias("artifact")
    files = spark.read.text(paths, wholetext=True)
    empty = list_artifacts(spark, paths, family).join(files.select(name), "artifact", "left_anti")
    return (files.select(F.lit(family).alias("family"), name, F.make_valid_utf8("value").alias("text"))
            .unionByName(empty.select("family", "artifact", F.lit("").alias("text"))))


def explode_lines(artifacts: DataFrame) -> DataFrame:
    """``(family, artifact, lineno, line)``, numbered from 1."""
    keep = [c for c in artifacts.columns if c != "text"]
    return (artifacts.select(*keep, F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
            .select(*keep, (F.col("pos") + 1).cast("bigint").alias("lineno"), "line"))


def read_lines(spark: SparkSession, paths: str | list[str], family: str) -> DataFrame:
    """The lines of text files of any size, the same as ``explode_lines(read_artifacts(…))``.

    A whole file must fit one row there (2 GB); here a file is read block by block on
    many tasks. Row ids are consecutive inside a block, so a line's number is its id
    less the block's first id plus the lines of the blocks before. The numbers of the
    blocks are found in a first pass and written; Spark sends them to every task as long as
    that table is small, and then the text is not shuffled. Blocks that hold a rarer line break (form
    feed, NEL and the like) are numbered by a window, one block at a time; the pass
    over them is left out when there is none.
    """
    rows = spark.read.text(paths).select(
        F.lit(family).alias("family"), F.col("_metadata.file_name").alias("artifact"), F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"),
        F.split(F.make_valid_utf8("value"), LINE_BREAK, -1).alias("_parts"))
    block = ["_path", "_block"]
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (rows.groupBy(*block).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"), F.sum(F.size("_parts")).alias("_lines"))
              .withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0))))
    blocks = stage(blocks, "blocks")
    even = blocks.where("_rows = _lines")
    plain = rows.join(even, block).select(
        "family", "artifact", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("lineno"), F.col("_parts")[0].alias("line"))
    if blocks.where("_rows <> _lines").isEmpty():
        return plain
    earlier = Window.partitionBy(*block).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    mixed = (rows.join(blocks.where("_rows <> _lines"), block)
             .withColumn("_start", F.col("_before") + F.coalesce(F.sum(F.size("_parts")).over(earlier), F.lit(0)))
             .select("family", "artifact", "_start", F.posexplode("_parts").alias("pos", "line"))
             .select("family", "artifact", (F.col("_start") + F.col("pos") + 1).alias("lineno"), "line"))
    return plain.unionByName(mixed)


def lines_of_text(df: DataFrame, family: str, artifact: Column, text: Column) -> DataFrame:
    """The same from any text column: pasted text, a message body, a stream."""
    return explode_lines(df.select(F.lit(family).alias("family"), artifact.alias("artifact"), text.alias("text")))


def sidecar_labels(artifacts: DataFrame) -> DataFrame:
    """``(artifact, key, value)`` from the ``- key: value`` bullets of sidecars.
    A continuation line is not part of the value's first line."""
    bullet = r"^- ([^:]{1,80}):\s*(.*)$"
    return (explode_lines(artifacts).where(F.col("line").startswith("- ") & F.col("line").rlike(bullet))
            .select("artifact", F.lower(F.trim(F.regexp_extract("line", bullet, 1))).alias("key"),
                    F.trim(F.regexp_extract("line", bullet, 2)).alias("value")))


def read_sidecars(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return sidecar_labels(read_artifacts(spark, paths, "sidecar"))

"""Cutting a plan at a written table.

Facts are far fewer than lines but several later steps read them, so a pipeline
writes them once to the shared checkpoint folder and reads them back: the raw
text is scanned a single time, later steps prune columns on Parquet, and a lost
executor costs a re-read instead of a re-parse.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables.

    ``spark.checkpoint.dir`` names it. Where that is unset, a local session takes a
    temporary folder, the same for its whole life, and a cluster a folder of the
    warehouse, which is shared by definition.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="faultscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has written to."""
    return f"{shared_folder(spark)}/faultscope/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return the reader of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every staged table of the shared folder, once their readers are done."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/faultscope")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

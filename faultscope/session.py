"""Session settings for local runs; a cluster brings its own."""

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]").appName("faultscope")
            .config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "8g")
            .getOrCreate())

"""Change counts over a growing log: the batch operator's result, kept up to date by Structured Streaming."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of (line, seen) from text files that are added to a folder, one path a line."""
    rows = spark.readStream.option("maxFilesPerTrigger", str(files_per_trigger)).text(folder)
    return rows.select(F.col("value").alias("line"), F.current_timestamp().alias("seen"))


def change_counts(log: DataFrame) -> DataFrame:
    """(path_key, path, changes) as operators.snapshots.change_counts(), of all lines so far; for output mode update or complete.

    The path shown is the least of its casings, since a stream has no first line for ever. State grows with distinct paths.
    """
    lines = log.select(F.trim("line").alias("path")).filter("path <> ''")
    return lines.groupBy(F.lower("path").alias("path_key")).agg(F.min("path").alias("path"), F.count("*").alias("changes"))


def windowed_counts(log: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, path_key, changes) in windows of ``seen``; what comes later than ``late`` is left out, so that state stays bounded."""
    lines = log.select(F.lower(F.trim("line")).alias("path_key"), "seen").filter("path_key <> ''").withWatermark("seen", late)
    return lines.groupBy(F.window("seen", window).alias("w"), "path_key").agg(F.count("*").alias("changes")).select(F.col("w.start").alias("start"), "path_key", "changes")

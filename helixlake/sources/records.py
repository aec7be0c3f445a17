"""Text files read in splits, with each record's place in its file."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_records(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, ordinal, value): the records of text files between separators (line ends by default), numbered from 0 in each file.

    Files are read in splits by many tasks. Inside a split, records follow each other in the order they are read; a split's
    first number is the count of records in the splits of the file before it. Empty files give no rows.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value", F.monotonically_increasing_id().alias("_at"))
    splits = raw.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select(F.col("file").alias("_f"), F.col("_start").alias("_s"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = raw.join(splits, (F.col("file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
    return placed.select("file", (F.col("_before") + F.col("_at") - F.col("_first")).alias("ordinal"), "value")

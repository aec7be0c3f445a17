"""An optional extension: run metrics as a file stream, rolled up by time window. The batch operators need none of it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_jsonl(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    """New JSON-lines files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).json(path)


def windowed_rollup(events: DataFrame, at: str, stage: str, seconds: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and seconds by stage and window; rows later than `late` behind the newest are dropped, so the state stays bounded."""
    w = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), F.col(stage).alias("stage"))
    return w.agg(F.count(F.lit(1)).alias("rows"), F.sum(seconds).alias("seconds")).select(F.col("w.start").alias("start"), "stage", "rows", "seconds")

"""Readers of the project's Parquet tables."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`; one file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

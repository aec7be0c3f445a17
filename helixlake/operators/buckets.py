"""Buckets of spectra by charge and m/z: members, pair counts and their costs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.operators.bandjoin import bucket_key


def bucket_sizes(df: DataFrame, charge: Column, value: Column, width: float) -> DataFrame:
    """(charge_id, bucket, n); a null charge is group 0, a null value counts as 0."""
    return df.groupBy(F.coalesce(charge, F.lit(0)).alias("charge_id"), bucket_key(F.coalesce(value, F.lit(0.0)), width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def surrogate_labels(df: DataFrame, charge: Column, value: Column, width: float, out: str = "cluster") -> DataFrame:
    """The bucket as the cluster: `z<charge>_b<n>`, truncated towards 0 as the older rule has it."""
    label = F.concat(F.lit("z"), F.coalesce(charge, F.lit(0)).cast("string"), F.lit("_b"), bucket_key(F.coalesce(value, F.lit(0.0)), width, "truncate").cast("string"))
    return df.withColumn(out, label)


def truncated(df: DataFrame, keys: list[Column], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of every bucket in order: a limit some comparisons put on buckets; use it only to repeat those."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def pair_survival(sizes: DataFrame) -> DataFrame:
    """One row from (n): spectra, all pairs, pairs inside buckets, survival ratio (0 without pairs) and reduction in percent."""
    pairs = lambda n: F.floor(n * (n - 1) / 2).cast("long")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("spectra"), F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).alias("candidate_pairs"))
    total = total.withColumn("all_pairs", pairs(F.col("spectra")))
    ratio = F.when(F.col("all_pairs") > 0, F.col("candidate_pairs") / F.col("all_pairs")).otherwise(0.0)
    return total.withColumn("survival_ratio", ratio).withColumn("reduction_percent", 100.0 * (1.0 - F.col("survival_ratio")))


def bucket_statistics(sizes: DataFrame, max_items: int) -> DataFrame:
    """Buckets, largest and mean size, and how many exceed `max_items`."""
    return sizes.agg(F.count(F.lit(1)).alias("buckets"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"), F.coalesce(F.sum(F.when(F.col("n") > max_items, 1).otherwise(0)), F.lit(0)).alias("overflowing"))

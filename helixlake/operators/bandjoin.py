"""Joins on a band of values, by equi-join on buckets with a residual condition."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: Column, width: float, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Rows of `left` and `right` with equal `on` columns and |left_value - right_value| <= tolerance, ends included.

    `tolerance` is an expression over the left row and may differ by row (for example parts per million of its value).
    The right row lies in one bucket of `width`, the left row is listed under every bucket its window touches, so a pair
    meets once and nothing need be made distinct. Choose `width` near twice the usual tolerance. Null values match nothing.
    Columns of both sides must differ in name but for `on`; how = "left" keeps unmatched left rows with nulls.
    """
    on = on or []
    lo, hi = F.col(left_value) - tolerance, F.col(left_value) + tolerance
    buckets = F.sequence(F.floor(lo / width), F.floor(hi / width))
    a = left.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_bucket", F.explode(F.when(F.col(left_value).isNotNull(), buckets)))
    b = right.where(F.col(right_value).isNotNull()).withColumn("_bucket", F.floor(F.col(right_value) / width))
    joined = a.join(b, [*on, "_bucket"]).where((F.col(right_value) >= F.col("_lo")) & (F.col(right_value) <= F.col("_hi"))).drop("_lo", "_hi", "_bucket")
    if how == "inner":
        return joined
    if how != "left":
        raise ValueError("inner or left")
    rest = left.join(joined.select(*left.columns).distinct(), left.columns, "left_anti")
    return joined.unionByName(rest, allowMissingColumns=True)


def open_band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, charge: str, right_charge: str, tolerance: Column, width: float) -> DataFrame:
    """Band join on equal charges; a left row whose charge `right` doesn't have at all is joined to every charge.

    The charges of `right` are its distinct values: a handful of rows whatever the data, so they are broadcast.
    """
    charges = right.select(F.col(right_charge).alias("_zs")).where("_zs IS NOT NULL").distinct()
    known = left.join(F.broadcast(charges), F.col(charge) == F.col("_zs"), "left")
    same = known.where(F.col("_zs").isNotNull()).withColumn("_z", F.col("_zs")).drop("_zs")
    every = charges.agg(F.collect_list("_zs").alias("_all"))
    other = known.where(F.col("_zs").isNull()).drop("_zs").join(F.broadcast(every)).withColumn("_z", F.explode("_all")).drop("_all")
    return band_join(same.unionByName(other), right.withColumn("_z", F.col(right_charge)), left_value, right_value, tolerance, width, ["_z"]).drop("_z")


def bucket_key(value: Column, width: float, how: str = "floor") -> Column:
    """floor(value / width) or, as older code does, truncation towards 0; a width of 0 or less gives one bucket."""
    if width <= 0:
        return F.lit(0).cast("long")
    return F.floor(value / width) if how == "floor" else (value / width).cast("long")


def bucket_pairs(df: DataFrame, id_col: str, keys: list[str], keep: Callable[[str], Column] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Pairs a < b of rows with equal keys. Meant for keys of few rows; the callers count a bucket's pairs instead where
    only their number matters (see `pair_survival`)."""
    columns = columns or []
    a = df.select(*keys, *(F.col(c).alias(f"{c}_a") for c in [id_col, *columns]))
    b = df.select(*keys, *(F.col(c).alias(f"{c}_b") for c in [id_col, *columns]))
    return a.join(b, keys).where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b"))


def max_within(intervals: DataFrame, samples: DataFrame, by: list[str], start: str, end: str, at: str, value: str, width: str, out: str = "peak") -> DataFrame:
    """For every interval the largest sample value with start <= at <= end; null without samples.

    Both sides are cut into time buckets of `width` seconds: an interval is listed under every bucket it touches. Interval
    rows are told apart by all their columns.
    """
    w = float(width)
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6 * w)
    a = intervals.withColumn("_b", F.explode(F.sequence(F.floor(seconds(start)), F.floor(seconds(end)))))
    b = samples.select(*by, F.col(at).alias("_at"), F.col(value).alias("_v"), F.floor(seconds(at)).alias("_b"))
    best = a.join(b, [*by, "_b"]).where((F.col("_at") >= F.col(start)) & (F.col("_at") <= F.col(end))).groupBy(*intervals.columns).agg(F.max("_v").alias(out))
    return intervals.join(best, intervals.columns, "left")

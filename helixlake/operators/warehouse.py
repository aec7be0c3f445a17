"""Run metrics: pairing cold and warm runs, intervals, roll-ups, counters, accuracies and manifests."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions.scalars import percent


def cold_warm_rows(cold: DataFrame, warm: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Every cold row with the warm time of the same keys (null if there is none), movement time and fraction.

    A warm key that occurs several times gives its mean, so rows don't fan out.
    """
    w = warm.groupBy(*keys).agg(F.avg(time).alias("warm_time"))
    out = cold.join(w, keys, "left")
    out = out.withColumn("movement_time", F.greatest(F.col(time) - F.col("warm_time"), F.lit(0.0)))
    return out.withColumn("movement_fraction", F.when(F.col(time) > 0, F.col("movement_time") / F.col(time)))


def cold_warm_medians(df: DataFrame, by: list[str], mode: str, time: str, cold: str = "cold", warm: str = "warm") -> DataFrame:
    """Median cold and warm times by group, their clamped difference and its share; groups with both modes only."""
    med = lambda m: F.median(F.when(F.col(mode) == m, F.col(time)))
    g = df.groupBy(*by).agg(med(cold).alias("cold_median"), med(warm).alias("warm_median")).where("cold_median IS NOT NULL AND warm_median IS NOT NULL")
    g = g.withColumn("movement", F.greatest(F.col("cold_median") - F.col("warm_median"), F.lit(0.0)))
    return g.withColumn("fraction", F.when(F.col("cold_median") > 0, F.col("movement") / F.col("cold_median")))


def movement_bytes(df: DataFrame, blocks: str, misses: str, block_size: int = 1024, line: int = 64) -> Column:
    """Bytes read from blocks; where there are none, cache misses times a line of 64 bytes."""
    b = F.coalesce(F.col(blocks), F.lit(0)) * block_size
    return F.when(b > 0, b).otherwise(F.coalesce(F.col(misses), F.lit(0)) * line)


def union_length(df: DataFrame, by: list[str], start: str, end: str, out: str = "covered") -> DataFrame:
    """(by, covered, islands): the length of the union of intervals; touching ones merge, negative ones count as empty.

    Gaps and islands: a row starts an island when its start lies after every earlier end. For hot groups, `premerge` first.
    """
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_e", F.greatest(start, end))
    w = Window.partitionBy(*by).orderBy(start, "_e")
    seen = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = rows.withColumn("_new", F.when(seen.isNull() | (F.col(start) > seen), 1).otherwise(0)).withColumn("_i", F.sum("_new").over(w))
    merged = island.groupBy(*by, "_i").agg(F.min(start).alias("_s"), F.max("_e").alias("_e"))
    return merged.groupBy(*by).agg(F.sum(F.col("_e") - F.col("_s")).alias(out), F.count(F.lit(1)).alias("islands"))


def premerge(df: DataFrame, by: list[str], start: str, end: str, width: float) -> DataFrame:
    """Intervals merged inside cells of `width` of their start, so that a hot group enters `union_length` with few rows."""
    cell = F.floor(F.col(start) / width)
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_e", F.greatest(start, end)).withColumn("_c", cell)
    w = Window.partitionBy(*by, "_c").orderBy(start, "_e")
    seen = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = rows.withColumn("_new", F.when(seen.isNull() | (F.col(start) > seen), 1).otherwise(0)).withColumn("_i", F.sum("_new").over(w))
    return island.groupBy(*by, "_c", "_i").agg(F.min(start).alias(start), F.max("_e").alias(end)).drop("_c", "_i")


def labelled(df: DataFrame, key: str, labels: DataFrame, label_key: str, label: str, out: str, prefix: str = "kind_") -> DataFrame:
    """A lookup whose missing keys are called `<prefix><key>`. The lookup is an enumeration of a few rows: broadcast."""
    return df.join(F.broadcast(labels.select(F.col(label_key).alias("_k"), F.col(label).alias("_l"))), F.col(key) == F.col("_k"), "left").withColumn(out, F.coalesce("_l", F.concat(F.lit(prefix), F.col(key).cast("string")))).drop("_k", "_l")


def direction_rollup(df: DataFrame, direction: str, size: str, time: str) -> DataFrame:
    """Bytes, count and time by copy direction, with its side: to or from the device, or else."""
    side = F.when(F.lower(direction).contains("htod"), "in").when(F.lower(direction).contains("dtoh"), "out").otherwise("other")
    return df.groupBy(F.col(direction).alias("direction"), side.alias("side")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("copies"), F.sum(time).alias("time"))


def stage_rollup(df: DataFrame, stage: str, done: str, seconds: str, size: str, rss: str) -> DataFrame:
    """By stage: rows, completed, their share, time, size, largest memory and throughput (null without time)."""
    g = df.groupBy(F.col(stage).alias("stage")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col(done), 1).otherwise(0)).alias("completed"), F.sum(seconds).alias("seconds"), F.sum(size).alias("bytes"), F.max(rss).alias("max_rss")
    )
    return g.withColumn("throughput", F.when(F.col("seconds") > 0, F.col("bytes") / F.col("seconds"))).withColumn("complete_percent", percent(F.col("completed"), F.col("rows")))


def alignment_counters(df: DataFrame, flags: str, mapq: str, span: Column, edits: Column) -> DataFrame:
    """Counters over alignments and the rates they give; secondary and supplementary rows only count as such."""
    f = lambda bit: F.col(flags).bitwiseAND(F.lit(bit)) != 0
    primary = ~f(0x100) & ~f(0x800)
    mapped = primary & ~f(0x4)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = df.agg(
        n(primary).alias("primary"), n(f(0x100)).alias("secondary"), n(f(0x800)).alias("supplementary"), n(mapped).alias("mapped"), n(mapped & f(0x2)).alias("proper"), n(mapped & ~f(0x8)).alias("both_mapped"), n(mapped & f(0x10)).alias("reverse"),
        n(mapped & (F.col(mapq) >= 20)).alias("mapq20"), n(mapped & (F.col(mapq) >= 30)).alias("mapq30"), F.sum(F.when(mapped, span)).alias("span"), F.sum(F.when(mapped & edits.isNotNull(), edits)).alias("edits"),
    )
    out = c.withColumn("mapped_percent", percent(F.col("mapped"), F.col("primary"))).withColumn("proper_percent", percent(F.col("proper"), F.col("primary")))
    out = out.withColumn("mapq20_percent", percent(F.col("mapq20"), F.col("mapped"))).withColumn("mapq30_percent", percent(F.col("mapq30"), F.col("mapped")))
    return out.withColumn("identity_percent", F.when(F.col("span") > 0, 100.0 * (1 - F.coalesce("edits", F.lit(0)) / F.col("span"))))


def mapping_accuracy(truth: DataFrame, observed: DataFrame, key: str, target: str, end: str, strand: str, tolerance: float) -> DataFrame:
    """Truth rows mapped, on the right target, ending within the tolerance, on the right strand; endpoint errors there."""
    o = observed.select(key, F.col(target).alias("_t"), F.col(end).alias("_e"), F.col(strand).alias("_s"))
    j = truth.join(o, key, "left")
    mapped, right = F.col("_t").isNotNull(), F.col("_t") == F.col(target)
    error = F.when(right, F.abs(F.col("_e") - F.col(end)))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return j.agg(
        F.count(F.lit(1)).alias("truth"), n(mapped).alias("mapped"), n(right).alias("right_target"), n(error <= tolerance).alias("within_tolerance"), n(right & (F.col("_s") == F.col(strand))).alias("right_strand"), F.median(error).alias("median_error"), F.avg(error).alias("mean_error")
    )


def list_totals(df: DataFrame, text: str, separator: str = ";") -> DataFrame:
    """Rows, summed list elements, and whether all or any row has a list; elements that aren't numbers count as 0."""
    values = F.transform(F.split(text, separator), lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long")))
    total = F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
    has = F.coalesce(F.col(text), F.lit("")) != ""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(total), F.lit(0)).alias("total"), F.bool_and(has).alias("all_listed"), F.bool_or(has).alias("any_listed"))


def unique_crosswalk(left: DataFrame, lookup: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """`left` joined to the lookup rows whose key occurs once there; and one row of counts: matched, ambiguous keys, shares."""
    uses = lookup.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_uses"))
    matched = left.join(lookup.join(uses.where("_uses = 1").select(key), key), key)
    report = uses.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(F.when(F.col("_uses") > 1, 1).otherwise(0)), F.lit(0)).alias("ambiguous_keys"))
    rows = left.join(uses, key, "left").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.when(F.col("_uses") == 1, 1).otherwise(0)), F.lit(0)).alias("matched"))
    report = report.join(F.broadcast(rows)).withColumn("matched_percent", percent(F.col("matched"), F.col("rows"))).withColumn("ambiguous_percent", percent(F.col("ambiguous_keys"), F.col("keys")))
    return matched, report


def manifest_status(manifest: DataFrame, found: DataFrame, key: str, size: str, found_size: str) -> DataFrame:
    """Per listed file: complete, partial (smaller), mismatch (larger) or missing."""
    j = manifest.join(found.select(key, F.col(found_size).alias("_f")), key, "left")
    s = F.when(F.col("_f").isNull(), "missing").when(F.col("_f") == F.col(size), "complete").when(F.col("_f") < F.col(size), "partial").otherwise("mismatch")
    return j.withColumn("status", s).drop("_f")


def routed(reads: DataFrame, candidates: DataFrame, read: str, target: str, strand: str, seq: str, rank: list[Column]) -> DataFrame:
    """Reads with their best candidate's target, the sequence turned round where its strand is `-`."""
    best = candidates.withColumn("_r", F.row_number().over(Window.partitionBy(read).orderBy(*rank))).where("_r = 1").select(read, target, strand)
    turned = F.when(F.col(strand) == "-", F.reverse(F.translate(F.col(seq), "ACGTN", "TGCAN"))).otherwise(F.col(seq))
    return reads.join(best, read).withColumn("oriented", turned)

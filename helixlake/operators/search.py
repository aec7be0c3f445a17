"""Search results: best hits, margins, calibration, q-values, group FDR and the two-stage cascade."""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions.bits import hamming_words
from helixlake.operators.bandjoin import band_join
from helixlake.operators.ordered import running_total
from helixlake.plans.lineage import materialise, new_path, remove


def best_hits(hits: DataFrame, query: str, item: str, score: str) -> DataFrame:
    """The best hit of every query: highest score, then smallest item."""
    best = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), item))
    return hits.withColumn("_r", best).where("_r = 1").drop("_r")


def group_max_with_ties(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """All rows whose score is their group's largest. A group sum isn't windowed: the maxima are aggregated and joined."""
    top = df.groupBy(*by).agg(F.max(score).alias("_top"))
    return df.join(top, by).where(F.col(score) == F.col("_top")).drop("_top")


def calibrated(hits: DataFrame, query: str, item: str, score: str, dim: int) -> DataFrame:
    """The best hit of every query with runner-up, margin and scores: raw, normalised 1 - 2d/D, z and z plus margin.

    d = dim - score is the Hamming distance. Mean and population deviation (at least 1e-6) run over the query's candidates;
    with one candidate the runner-up is the best itself and the margin 0. A hot query is aggregated, not windowed: count,
    sums and the two best candidates are partial aggregates.
    """
    top = F.min(F.struct((-F.col(score)).alias("s"), F.col(item).alias("item")))
    stats = hits.groupBy(query).agg(F.count(F.lit(1)).alias("candidates"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), top.alias("best"))
    second = hits.join(stats.select(query, F.col("best.item").alias("_bi")), query).where(F.col(item) != F.col("_bi")).groupBy(query).agg(F.max(score).alias("second"))
    out = stats.join(second, query, "left").select(
        query, F.col("best.item").alias(item), (-F.col("best.s")).alias(score), "candidates", "mean", F.greatest("sd", F.lit(1e-6)).alias("sd"), F.coalesce("second", -F.col("best.s")).alias("runner_up")
    )
    out = out.withColumn("margin", F.col(score) - F.col("runner_up")).withColumn("normalized", 1.0 - 2.0 * (F.lit(float(dim)) - F.col(score)) / dim)
    return out.withColumn("zscore", (F.col(score) - F.col("mean")) / F.col("sd")).withColumn("zscore_margin", F.col("zscore") + F.col("margin") / F.col("sd"))


def q_values(df: DataFrame, score: str, decoy: str, by: list[str] | None = None, out: str = "q") -> DataFrame:
    """q-values within `by` (or over all rows): decoys so far over targets so far by descending score, made monotone.

    Rows of equal score share one value (counted after all of them). The ratio is null-safe: before the first target it is
    decoys / 1. Instead of a window over all rows, which one task would have to hold, the rows are first aggregated to
    counts per distinct score; those are range-partitioned by score, each partition gets the totals of those before it, and
    prefix sums are taken inside partitions. The monotone minimum runs the other way round in the same manner.
    """
    by = by or []
    steps = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.when(F.col(decoy), 1).otherwise(0)).alias("_d"), F.sum(F.when(F.col(decoy), 0).otherwise(1)).alias("_t"))
    keys = [*by, "_s"]
    # In partitions ordered by key; the partition number is written, so that both passes see the same partitions.
    parted = materialise(steps.repartitionByRange(*(F.col(c) for c in by), F.col("_s").desc()).withColumn("_p", F.spark_partition_id()), "scores")
    totals = parted.groupBy(*by, "_p").agg(F.sum("_d").alias("_pd"), F.sum("_t").alias("_pt"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_p", F.coalesce(F.sum("_pd").over(earlier), F.lit(0)).alias("_bd"), F.coalesce(F.sum("_pt").over(earlier), F.lit(0)).alias("_bt"))
    within = Window.partitionBy(*by, "_p").orderBy(F.desc("_s"))
    run = parted.join(F.broadcast(totals) if not by else totals, [*by, "_p"])
    run = run.withColumn("_f", (F.col("_bd") + F.sum("_d").over(within)) / F.greatest(F.col("_bt") + F.sum("_t").over(within), F.lit(1)))
    run = materialise(run.select(*keys, "_p", "_f"), "fdr")
    lowest = run.groupBy(*by, "_p").agg(F.min("_f").alias("_m"))
    later = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    lowest = lowest.select(*by, "_p", F.min("_m").over(later).alias("_later"))
    below = Window.partitionBy(*by, "_p").orderBy("_s")
    run = run.join(F.broadcast(lowest) if not by else lowest, [*by, "_p"]).withColumn(out, F.least(F.min("_f").over(below), F.coalesce("_later", F.lit(float("inf")))))
    return df.join(run.select(*by, F.col("_s").alias(score), out), [*by, score])


def accepted(df: DataFrame, score: str, decoy: str, fdr: float, by: list[str] | None = None) -> DataFrame:
    """Targets with a q-value of at most `fdr`."""
    return q_values(df, score, decoy, by).where(~F.col(decoy) & (F.col("q") <= fdr))


def mass_difference(observed: Column, calculated: Column, charge: Column) -> Column:
    return (observed - calculated) * charge


def mass_groups(df: DataFrame, id_col: str, score: str, diff: str, tolerance: float, min_size: int, ppm_of: str | None = None, out: str = "mass_group", finish_rows: int = 200_000) -> DataFrame:
    """Greedy groups by mass difference: the best remaining row takes all remaining rows within the tolerance.

    Groups of fewer than `min_size` rows share group -1, the others are named by their best row. Equal scores go by id. With
    `ppm_of`, the tolerance is in millionths of each row's own value. Rows with a null difference are left out.

    A row is a centre if no better centre reaches it, and a row belongs to the best centre that does. So centres are found in
    rounds, however dense the differences: in cells as wide as the widest tolerance, the best remaining row of a cell that
    beats the best of both neighbours is one, and the rows it reaches drop out. Once at most `finish_rows` rows are left
    (checked), one task applies the rule as it stands. Rounds are written to the shared folder.
    """
    spark, spent = df.sparkSession, []

    def keep(frame: DataFrame, label: str) -> DataFrame:
        spent.append(new_path(spark, label))
        return materialise(frame, label, spent[-1])

    rows = df.where(F.col(diff).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("_s"), F.col(diff).cast("double").alias("_m"), (F.col(ppm_of).cast("double") if ppm_of else F.lit(1e6)).alias("_o"))
    step = max(tolerance if not ppm_of else (df.agg(F.max(ppm_of)).first()[0] or 0.0) * tolerance / 1e6, 1e-9) * (1 + 1e-9)
    rows = keep(rows.withColumn("_c", F.floor(F.col("_m") / step)), "masses")
    best = F.min(F.struct((-F.col("_s")).alias("s"), F.col("_id").alias("i"), F.col("_m").alias("m")))
    reached = F.abs(F.col("_m") - F.col("_b.m")) / F.col("_o") * 1e6 <= tolerance

    def near(centres: DataFrame) -> DataFrame:
        """Of every cell that a centre can reach, its centres."""
        return centres.select(F.explode(F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1)).alias("_c"), "_b")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_s", "_id"], ascending=[False, True], kind="stable")
        mass, reach, left, chosen = pdf["_m"].to_numpy(), pdf["_o"].to_numpy(), np.arange(len(pdf)), []
        while len(left):
            chosen.append(left[0])
            left = left[~(np.abs(mass[left] - mass[left[0]]) / reach[left] * 1e6 <= tolerance) & (left != left[0])]
        return pdf.iloc[chosen][["_c", "_s", "_id", "_m"]]

    kind = dict(rows.dtypes)["_id"]
    left, found = rows, []
    while left.count() > finish_rows:
        cells = keep(left.groupBy("_c").agg(best.alias("_b")), "cells")
        beside = cells.select(F.explode(F.array(F.col("_c") - 1, F.col("_c") + 1)).alias("_c"), F.col("_b").alias("_other")).groupBy("_c").agg(F.min("_other").alias("_other"))
        centres = keep(cells.join(beside, "_c", "left").where(F.col("_other").isNull() | (F.col("_b") < F.col("_other"))).select("_c", "_b"), "centres")
        found.append(centres)
        gone = left.join(near(centres), "_c").where(reached | (F.col("_id") == F.col("_b.i"))).select("_id").distinct()
        left = keep(left.join(gone, "_id", "left_anti"), "masses")
    last = left.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(greedy, f"_c long, _s double, _id {kind}, _m double")
    found.append(keep(last.select("_c", F.struct((-F.col("_s")).alias("s"), F.col("_id").alias("i"), F.col("_m").alias("m")).alias("_b")), "centres"))
    centres = reduce(lambda a, b: a.unionByName(b), found)
    owned = rows.join(near(centres), "_c").where(reached | (F.col("_id") == F.col("_b.i"))).groupBy("_id").agg(F.min("_b").alias("_b"))
    owned = materialise(owned.select("_id", F.col("_b.i").alias("_g")), "mass-groups")
    large = owned.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size).select("_g", F.col("_g").cast("string").alias("_name"))
    remove(spark, *spent)
    named = owned.join(large, "_g", "left").select(F.col("_id").alias(id_col), F.coalesce("_name", F.lit("-1")).alias(out))
    return df.join(named, id_col)


def cascade(standard: DataFrame, opened: DataFrame, query: str, score: str, decoy: str, fdr: float, group: str | None = None) -> DataFrame:
    """Accepted standard hits, then accepted open hits of the queries without one; `stage` tells them apart."""
    first = accepted(standard, score, decoy, fdr)
    retry = opened.join(first.select(query), query, "left_anti")
    second = accepted(retry, score, decoy, fdr, [group] if group else None)
    return first.withColumn("stage", F.lit("standard")).unionByName(second.withColumn("stage", F.lit("open")), allowMissingColumns=True)


def standard_stage(queries: DataFrame, library: DataFrame, tolerance: Column, width: float, dim: int) -> DataFrame:
    """(query, item, similarity, is_decoy, q): the best item of every query by equal bits (then smallest item), and its q-value.

    queries: query, charge, query_mz, qw; library: item, charge, precursor_mz, w, is_decoy, the vectors as words. Candidates
    have the query's charge and lie within `tolerance`. A query without a candidate is left out; the best candidate is an
    aggregate, so a hot query isn't windowed.
    """
    pairs = band_join(queries, library, "query_mz", "precursor_mz", tolerance, width, ["charge"])
    scored = pairs.select("query", "item", "is_decoy", (F.lit(dim) - hamming_words(F.col("qw"), F.col("w"))).alias("similarity"))
    best = scored.groupBy("query").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "item", "is_decoy")).alias("b"))
    return q_values(best.select("query", "b.item", (-F.col("b.s")).alias("similarity"), "b.is_decoy"), "similarity", "is_decoy")


def calibration_grid(queries: DataFrame, library: DataFrame, settings: list[dict], modes: list[str], encode, fdr: float) -> DataFrame:
    """(label, mode, identified, error): accepted queries for every setting of an encoder and every score mode.

    `encode(spectra, setting)` gives (query or item, w); each setting is encoded and compared once, whatever the number of
    modes. queries: query, charge, query_mz; library: item, charge, precursor_mz, is_decoy. A setting that fails is a row with
    its error and the others go on.
    """
    spark, rows = queries.sparkSession, []
    for setting in settings:
        label = "_".join(f"{k}={v}" for k, v in sorted(setting.items()))
        try:
            q, lib = encode(queries, setting), encode(library, setting)
            dim = setting["dim"]
            pairs = band_join(q.withColumnRenamed("w", "qw"), lib, "query_mz", "precursor_mz", F.lit(2.0), 4.0, ["charge"])
            scored = materialise(pairs.select("query", "item", "is_decoy", (F.lit(dim) - hamming_words(F.col("qw"), F.col("w"))).alias("score")), "grid")
            best = materialise(calibrated(scored, "query", "item", "score", dim).join(scored.select("item", "is_decoy").distinct(), "item"), "grid")
            rows += [(label, mode, accepted(best, mode, "is_decoy", fdr).count(), None) for mode in modes]
        except Exception as e:  # noqa: BLE001
            rows.append((label, None, None, str(e).splitlines()[0][:200]))
    return spark.createDataFrame(rows, "label string, mode string, identified long, error string")


def score_summary(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Count, mean, median, interpolated 95th percentile and maximum of a score; nulls where there is none."""
    return df.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.median(score).alias("median"), F.percentile(score, 0.95).alias("p95"), F.max(score).alias("largest"))


def count_summary(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, nearest-rank p95 by truncation (the value at position int(0.95 (n - 1))), maximum and total.

    The values are counted first; the position is found in their cumulated counts, so no list of all rows is formed.
    """
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")).where("v IS NOT NULL")
    total = counts.agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total"), F.max("v").alias("largest"))
    upto = running_total(counts, [F.col("v")], F.col("c"), "before").withColumn("upto", F.col("before") + F.col("c"))
    at = upto.join(F.broadcast(total.select("n"))).where(F.col("upto") > F.floor(0.95 * (F.col("n") - 1))).agg(F.min("v").alias("p95"))
    return total.join(F.broadcast(at)).select("n", (F.col("total") / F.col("n")).alias("mean"), "p95", "largest", "total")

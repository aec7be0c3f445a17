"""Quality of a clustering against labels, all from the contingency table."""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) of the rows that have both."""
    return df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(c):
    return F.sum(F.col(c) * (F.col(c) - 1) / 2)


def cluster_metrics(table: DataFrame) -> DataFrame:
    """One row of metrics from a contingency table.

    Pair precision, recall (1 without pairs) and F1 (0 if both are 0), adjusted Rand index, normalised mutual information
    (arithmetic mean), homogeneity, completeness, B-cubed precision, recall and F1, exactly matched clusters and their
    ratio, and the agreement of the numbers of clusters. No rows: everything null or 0.
    """
    rows = table.groupBy("truth").agg(F.sum("n").alias("a"))
    cols = table.groupBy("predicted").agg(F.sum("n").alias("b"))
    cells = table.join(rows, "truth").join(cols, "predicted")
    n = F.col("n")
    c = cells.agg(
        F.sum("n").alias("total"),
        F.coalesce(_pairs("n"), F.lit(0.0)).alias("both"),
        F.sum(n * n / F.col("b")).alias("bp"),
        F.sum(n * n / F.col("a")).alias("br"),
        F.sum(n * F.log(n.cast("double"))).alias("snn"),
        F.sum(F.when((n == F.col("a")) & (n == F.col("b")), 1).otherwise(0)).alias("exact"),
    )
    a = rows.agg(F.count(F.lit(1)).alias("na"), F.coalesce(_pairs("a"), F.lit(0.0)).alias("pa"), F.sum(F.col("a") * F.log(F.col("a").cast("double"))).alias("saa"))
    b = cols.agg(F.count(F.lit(1)).alias("nb"), F.coalesce(_pairs("b"), F.lit(0.0)).alias("pb"), F.sum(F.col("b") * F.log(F.col("b").cast("double"))).alias("sbb"))
    # one row each
    m = c.join(F.broadcast(a)).join(F.broadcast(b))
    t = F.col("total")
    m = m.withColumn("ha", F.log(t.cast("double")) - F.col("saa") / t).withColumn("hb", F.log(t.cast("double")) - F.col("sbb") / t)
    m = m.withColumn("mi", F.log(t.cast("double")) + (F.col("snn") - F.col("saa") - F.col("sbb")) / t)
    m = m.withColumn("precision", F.when(F.col("pb") > 0, F.col("both") / F.col("pb")).otherwise(1.0)).withColumn("recall", F.when(F.col("pa") > 0, F.col("both") / F.col("pa")).otherwise(1.0))
    f1 = lambda p, r: F.when(F.col(p) + F.col(r) > 0, 2 * F.col(p) * F.col(r) / (F.col(p) + F.col(r))).otherwise(0.0)
    m = m.withColumn("all", t * (t - 1) / 2).withColumn("expected", F.when(F.col("all") > 0, F.col("pa") * F.col("pb") / F.col("all")).otherwise(0.0))
    best = (F.col("pa") + F.col("pb")) / 2
    m = m.withColumn("bcubed_precision", F.col("bp") / t).withColumn("bcubed_recall", F.col("br") / t)
    return m.select(
        t.alias("n"),
        "precision",
        "recall",
        f1("precision", "recall").alias("f1"),
        F.when(best - F.col("expected") != 0, (F.col("both") - F.col("expected")) / (best - F.col("expected"))).otherwise(1.0).alias("ari"),
        F.when(F.col("ha") + F.col("hb") > 1e-12, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).otherwise(1.0).alias("nmi"),
        F.when(F.col("ha") > 1e-12, F.col("mi") / F.col("ha")).otherwise(1.0).alias("homogeneity"),
        F.when(F.col("hb") > 1e-12, F.col("mi") / F.col("hb")).otherwise(1.0).alias("completeness"),
        "bcubed_precision",
        "bcubed_recall",
        f1("bcubed_precision", "bcubed_recall").alias("bcubed_f1"),
        F.col("exact").alias("exact_clusters"),
        F.when(F.col("na") > 0, F.col("exact") / F.col("na")).alias("exact_ratio"),
        F.when(F.greatest("na", "nb") > 0, F.least("na", "nb") / F.greatest("na", "nb")).alias("count_agreement"),
    )


def incorrect_ratio(df: DataFrame, label: str, cluster: str, noise: int = -1) -> DataFrame:
    """Members that differ from their cluster's majority label over the rows in non-noise clusters (0 without any)."""
    rows = df.where(F.col(label).isNotNull() & (F.col(cluster) != noise)).groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    per = rows.groupBy(cluster).agg(F.sum("n").alias("size"), F.max("n").alias("major"))
    return per.agg(F.coalesce(F.sum(F.col("size") - F.col("major")), F.lit(0)).alias("incorrect"), F.coalesce(F.sum("size"), F.lit(0)).alias("members")).withColumn(
        "incorrect_ratio", F.when(F.col("members") > 0, F.col("incorrect") / F.col("members")).otherwise(0.0)
    )


def incorrect_ratio_identified(df: DataFrame, label: str, cluster: str, noise: int = -1) -> DataFrame:
    """The older variant: null labels are ignored, clusters of one label give nothing, 1e-6 is added to the denominator."""
    rows = df.where(F.col(cluster) != noise).groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n")).where(F.col(label).isNotNull())
    per = rows.groupBy(cluster).agg(F.sum("n").alias("size"), F.max("n").alias("major"), F.count(F.lit(1)).alias("labels"))
    wrong = F.sum(F.when(F.col("labels") > 1, F.col("size") - F.col("major")).otherwise(0))
    return per.agg(F.coalesce(wrong, F.lit(0)).alias("incorrect"), F.coalesce(F.sum("size"), F.lit(0)).alias("members")).withColumn("incorrect_ratio", F.col("incorrect") / (F.col("members") + 1e-6))


def size_histogram(df: DataFrame, cluster: str, edges: list[int], noise: int = -1) -> DataFrame:
    """(lower, upper, clusters, members) of left-closed size ranges; the last is open. Empty ranges are kept."""
    spark = df.sparkSession
    bounds = [(lo, hi) for lo, hi in zip(edges, [*edges[1:], None], strict=True)]
    ranges = spark.createDataFrame(bounds, "lower long, upper long")
    sizes = df.where(F.col(cluster) != noise).groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    lower = F.lit(None).cast("long")
    for lo, _ in bounds:
        lower = F.when(F.col("size") >= lo, F.lit(lo).cast("long")).otherwise(lower)
    counted = sizes.withColumn("lower", lower).groupBy("lower").agg(F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("members"))
    return ranges.join(counted, "lower", "left").select("lower", "upper", F.coalesce("clusters", F.lit(0)).alias("clusters"), F.coalesce("members", F.lit(0)).alias("members"))


def size_filtered(df: DataFrame, cluster: str, least: int, below: int, out: str) -> DataFrame:
    """The cluster where its size is in [least, below), else -1. Sizes are aggregated and joined, so a hot cluster is no window."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(sizes, cluster, "left").withColumn(out, F.when((F.col("_n") >= least) & (F.col("_n") < below), F.col(cluster)).otherwise(-1)).drop("_n")


def clustered_share(df: DataFrame, cluster: str, noise: int = -1) -> DataFrame:
    return df.agg(F.sum(F.when(F.col(cluster) != noise, 1).otherwise(0)).alias("clustered"), F.sum(F.when(F.col(cluster) == noise, 1).otherwise(0)).alias("noise"), F.avg(F.when(F.col(cluster) != noise, 1.0).otherwise(0.0)).alias("clustered_share"))


def weighted_means(df: DataFrame, weight: str, metrics: list[str]) -> DataFrame:
    """Metrics averaged with a weight; rows where a metric is null don't count for it."""
    return df.agg(*(F.try_divide(F.sum(F.col(m) * F.col(weight)), F.sum(F.when(F.col(m).isNotNull(), F.col(weight)))).alias(m) for m in metrics))


def assignment_accuracy(table: DataFrame, max_labels: int = 2000) -> float:
    """Rows on the best one-to-one match of truth labels and clusters over all rows (Hungarian method).

    The contingency table must have at most `max_labels` labels a side, which is checked; ValueError beyond.
    """
    na, nb = table.select("truth").distinct().count(), table.select("predicted").distinct().count()
    if max(na, nb) > max_labels:
        raise ValueError(f"{max(na, nb)} labels; the solver is bounded to {max_labels}")
    cells = table.collect()
    if not cells:
        return 0.0
    rows, cols = sorted({str(r["truth"]) for r in cells}), sorted({str(r["predicted"]) for r in cells})
    gain = np.zeros((len(rows), len(cols)))
    ri, ci = {v: i for i, v in enumerate(rows)}, {v: i for i, v in enumerate(cols)}
    for r in cells:
        gain[ri[str(r["truth"])], ci[str(r["predicted"])]] += r["n"]
    return float(best_assignment(gain) / gain.sum())


def best_assignment(gain: np.ndarray) -> float:
    """The largest total of a one-to-one assignment, by shortest augmenting paths with potentials."""
    cost = -(gain if gain.shape[0] <= gain.shape[1] else gain.T)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        match[0] = i
        j0, least, way, used = 0, np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return float(sum(-cost[match[j] - 1, j - 1] for j in range(1, m + 1) if match[j]))


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """MAE, MSE, RMSE and R2 (null without spread) over rows that have both values."""
    e = F.col(predicted) - F.col(truth)
    rows = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    m = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(truth).alias("_v"))
    return m.select("n", "mae", "mse", F.sqrt("mse").alias("rmse"), F.when(F.col("_v") > 0, 1.0 - F.col("mse") / F.col("_v")).alias("r2"))


def recall_of_top(exact: DataFrame, kept: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """One row: exact top-k hits, those kept, queries that keep all k, and whether rank 1 is kept.

    `exact` has (query, item, place); `kept` the surviving (query, item).
    """
    joined = exact.join(kept.select(query, item).distinct().withColumn("_k", F.lit(1)), [query, item], "left")
    per = joined.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("_k", F.lit(0))).alias("kept"), F.max(F.when(F.col("place") == 1, F.coalesce("_k", F.lit(0)))).alias("first"))
    return per.agg(F.sum("n").alias("exact"), F.sum("kept").alias("retained"), F.avg(F.when(F.col("kept") == F.col("n"), 1.0).otherwise(0.0)).alias("full_query_recall"), F.avg("first").alias("top1_recall"), F.avg("kept").alias("mean_retained"))


def placed(df: DataFrame, by: list[str], order: list, out: str = "place") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

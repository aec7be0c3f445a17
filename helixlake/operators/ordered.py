"""Cut-offs, samples, tiers, placements and limits that depend on an order; and set comparisons."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.plans.lineage import materialise


def running_total(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """The sum of `value` over the rows before a row in a total order, without one task for all rows.

    Rows are range-partitioned by the order, partition totals are prefixed, sums run inside partitions.
    """
    spread = df.withColumn("_total_v", F.coalesce(value, F.lit(0))).repartitionByRange(*order).withColumn("_total_p", F.spark_partition_id())
    parted = materialise(spread, "ordered")
    totals = parted.groupBy("_total_p").agg(F.sum("_total_v").alias("_total_t"))
    totals = totals.select("_total_p", F.coalesce(F.sum("_total_t").over(Window.orderBy("_total_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_total_b"))
    inside = Window.partitionBy("_total_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parted.join(F.broadcast(totals), "_total_p").withColumn(out, F.col("_total_b") + F.coalesce(F.sum("_total_v").over(inside), F.lit(0))).drop("_total_p", "_total_v", "_total_b")


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Row numbers from 0 in a total order."""
    return running_total(df, order, F.lit(1).cast("long"), out)


def until_total(df: DataFrame, order: list[Column], size: str, target: float, out: str = "before") -> DataFrame:
    """Rows in order while the total of those before is below `target`: the crossing row is included."""
    return running_total(df, order, F.col(size), out).where(F.col(out) < target)


def truncated_to_total(df: DataFrame, order: list[Column], text: str, target: int) -> DataFrame:
    """Like `until_total` over the lengths of `text`, but the crossing text is cut to the exact remainder."""
    cut = running_total(df, order, F.length(text), "before").where(F.col("before") < target)
    return cut.withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(target) - F.col("before")).cast("int")))


def hash_order(*columns: str, seed: str = "") -> list[Column]:
    """A deterministic shuffle: by SHA-256 of the columns (with a seed), then by themselves."""
    return [F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in columns)), 256), *(F.col(c) for c in columns)]


def rank_tiers(df: DataFrame, order: list[Column], tiers: int, out: str = "tier") -> DataFrame:
    """floor(rank * tiers / n), the first in order in tier 0."""
    n = df.count()
    return numbered(df, order, "_rank").withColumn(out, F.floor(F.col("_rank") * tiers / F.lit(max(n, 1)))).drop("_rank")


def round_robin(df: DataFrame, order: list[Column], tiles: int, columns: int) -> DataFrame:
    """tile = i mod tiles, column = i div tiles, up to tiles * columns rows."""
    return numbered(df, order, "_i").where(F.col("_i") < tiles * columns).withColumn("tile", F.pmod("_i", F.lit(tiles))).withColumn("column", F.floor(F.col("_i") / tiles)).drop("_i")


def transitions(df: DataFrame, by: str, order: list[str], value: str, tier: str) -> DataFrame:
    """(by, steps, switches, hops): changes of `value` and summed tier distances between consecutive rows.

    `by` groups are paths, whose length is bounded by one read.
    """
    w = Window.partitionBy(by).orderBy(*order)
    step = df.select(by, F.col(value).alias("v"), F.lag(value).over(w).alias("pv"), F.col(tier).alias("t"), F.lag(tier).over(w).alias("pt")).where("pv IS NOT NULL")
    return step.groupBy(by).agg(F.count(F.lit(1)).alias("steps"), F.sum(F.when(F.col("v") != F.col("pv"), 1).otherwise(0)).alias("switches"), F.sum(F.abs(F.col("t") - F.col("pt"))).alias("hops"))


def consecutive_deltas(df: DataFrame, order: list[str], gained: str, lost: str, out: str = "marginal") -> DataFrame:
    """Loss per gain from one row of a parameter sweep to the next; null where nothing is gained. A sweep is a few rows."""
    w = Window.orderBy(*order)
    g, x = F.col(gained) - F.lag(gained).over(w), F.lag(lost).over(w) - F.col(lost)
    return df.withColumn(out, F.when(g > 0, x / g))


def best_setting(df: DataFrame, recall: str, reduction: str, least: float) -> DataFrame:
    """Among rows of at least `least` recall the one with most (reduction, recall), else the one with most (recall, reduction)."""
    good = F.struct(F.lit(1).alias("ok"), F.col(reduction).alias("x"), F.col(recall).alias("y"), F.struct(*df.columns).alias("row"))
    bad = F.struct(F.lit(0).alias("ok"), F.col(recall).alias("x"), F.col(reduction).alias("y"), F.struct(*df.columns).alias("row"))
    return df.agg(F.max(F.when(F.col(recall) >= least, good).otherwise(bad)).alias("b")).where("b IS NOT NULL").select("b.row.*")


def first_share(df: DataFrame, order: list[Column], share: float) -> DataFrame:
    """The first `share` of the rows in order, rounded down, at least one. The rows are counted and read again, so `df` is
    written to the shared folder first."""
    df = materialise(df, "ordered")
    return numbered(df, order, "_i").where(F.col("_i") < max(1, int(df.count() * share))).drop("_i")


def thresholds(df: DataFrame, value: str, percentiles: list[float]) -> DataFrame:
    """Distinct floored percentiles of a column: the thresholds of a sweep."""
    p = df.agg(F.percentile(value, F.array(*(F.lit(x / 100) for x in percentiles))).alias("p"))
    return p.select(F.explode("p").alias("t")).where("t IS NOT NULL").select(F.floor("t").alias("threshold")).distinct()


def capped_groups(df: DataFrame, group: str, order: list[Column], per_group: int, cap: int) -> DataFrame:
    """At most `per_group` rows of every group; groups by size (then name) are taken whole until one would exceed `cap`
    in all, which is skipped.

    Taken sizes never rise in that order, so the rule is one of counts: of the groups with equal taken size, the first
    floor(what is left / size) are kept. The driver sees a count for each of at most `per_group` taken sizes, and the groups
    themselves are found by a top-k for each size that isn't kept as a whole.
    """
    kept = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= per_group).drop("_r")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_take", F.least(F.col("_n"), F.lit(per_group)))
    left, whole, parts = cap, [], []
    for row in sizes.groupBy("_take").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("_take")).collect():
        n = min(row["c"], left // row["_take"])
        left -= n * row["_take"]
        if n == row["c"]:
            whole.append(row["_take"])
        elif n:
            parts.append(sizes.where(F.col("_take") == row["_take"]).orderBy(F.desc("_n"), group).limit(n).select(group))
    chosen = reduce(lambda a, b: a.unionByName(b), parts, sizes.where(F.col("_take").isin(whole)).select(group))
    return kept.join(chosen.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left_semi")


def aligned_union(parts: dict[str, DataFrame], columns: list[str], source: str = "source") -> DataFrame:
    """UNION ALL with the fixed columns first (null where missing), extra columns after them, and where a row is from."""
    tagged = [df.withColumn(source, F.lit(name)) for name, df in parts.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    for c in columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*columns, *(c for c in out.columns if c not in columns))


def common_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't among the completed ones: resuming a run."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def equal_groups(a: DataFrame, b: DataFrame, item: str, group_a: str, group_b: str) -> DataFrame:
    """(group_a, group_b, n) of groups with exactly the same members, from a contingency table instead of member lists."""
    cells = a.select(item, group_a).join(b.select(item, group_b), item).groupBy(group_a, group_b).agg(F.count(F.lit(1)).alias("n"))
    na, nb = a.groupBy(group_a).agg(F.count(F.lit(1)).alias("_na")), b.groupBy(group_b).agg(F.count(F.lit(1)).alias("_nb"))
    return cells.join(na, group_a).join(nb, group_b).where((F.col("n") == F.col("_na")) & (F.col("n") == F.col("_nb"))).select(group_a, group_b, "n")


def equivalent_inputs(a: DataFrame, b: DataFrame, text: str, order: str | None = None) -> DataFrame:
    """One row: whether two inputs agree in count, total length, length histogram and content, as multisets or, with the column
    `order`, also in the order of their texts.

    The content digest is the sum of 64-bit hashes, those of an order take the row's number in, so no single task is needed.
    """

    def one(df: DataFrame) -> DataFrame:
        place = F.lit(0)
        if order is not None:
            df, place = numbered(df.select(order, text), [F.col(order), F.col(text)], "_i"), F.col("_i")
        total = lambda c: F.sum(c.cast("decimal(38,0)"))
        return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("bases"), total(F.xxhash64(F.length(text))).alias("lengths"), total(F.xxhash64(F.col(text), place)).alias("content"))

    x, y = one(a), one(b)
    named = x.toDF(*(f"a_{c}" for c in x.columns)).join(F.broadcast(y.toDF(*(f"b_{c}" for c in y.columns))))
    same = reduce(lambda p, q: p & q, [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in x.columns])
    return named.select(F.col("a_n").alias("n_a"), F.col("b_n").alias("n_b"), F.col("a_bases").alias("bases_a"), F.col("b_bases").alias("bases_b"), same.alias("equivalent"))

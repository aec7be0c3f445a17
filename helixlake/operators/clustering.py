"""Complete-linkage clustering inside buckets, and components of a distance graph."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.operators.ordered import numbered
from helixlake.plans.lineage import materialise, new_path, remove


def complete_linkage(distance: np.ndarray, cutoff: float) -> np.ndarray:
    """Labels 0, 1, ... by complete linkage with merges up to `cutoff`: no two members of a cluster are farther apart.

    The closest pair of clusters is merged while it is within the cutoff (smallest indices on ties), which equals what
    nearest-neighbour chains give for this linkage. Nearest neighbours are kept per row, so a merge costs one row.
    """
    n = len(distance)
    d = distance.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    alive, owner = np.ones(n, bool), np.arange(n)
    if n < 2:
        return np.zeros(n, np.int64)
    near = d.argmin(axis=1)
    best = d[np.arange(n), near]
    while True:
        i = int(best.argmin())
        if not best[i] <= cutoff:
            break
        i, j = sorted((i, int(near[i])))
        owner[owner == j] = i
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        alive[j], best[j] = False, np.inf
        for r in np.flatnonzero(alive & ((near == i) | (near == j))).tolist() + [i]:
            near[r] = int(d[r].argmin())
            best[r] = d[r, near[r]]
    return np.unique(owner, return_inverse=True)[1]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of every row of `x` and `y`, vectors as words."""
    return np.stack([np.bitwise_count(y ^ r).sum(axis=1, dtype=np.int32) for r in x]) if len(x) else np.empty((0, len(y)), np.int32)


def _words(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


def _linked(pdf: pd.DataFrame, most: float) -> pd.DataFrame:
    """(a, b): of the rows of two blocks (`side` 0 and 1, or one block of side -1), each with the smallest row of its component
    in the graph of pairs at most `most` bits apart."""
    pdf = pdf.sort_values("id")
    v, side, root = _words(pdf["hv"]), pdf["side"].to_numpy(), np.arange(len(pdf))
    left, right = np.flatnonzero(side < 1), np.flatnonzero(side != 0)
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        i, j = np.nonzero(_distances(v[part], v[right]) <= most)
        i, j = part[i], right[j]
        while len(i):
            lo, hi = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            np.minimum.at(root, hi, lo)
            while not np.array_equal(root[root], root):
                root = root[root]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
    ids = pdf["id"].to_numpy()
    joined = root != np.arange(len(root))
    return pd.DataFrame({"a": ids[joined], "b": ids[root[joined]]})


def bucket_clusters(df: DataFrame, id_col: str, keys: list[str], hv_col: str, n_bytes: int, ratio: float = 0.455, max_bucket: int = 8000, prefix: str = "c") -> DataFrame:
    """(id, cluster): complete linkage inside every bucket of equal `keys`, cut at ratio * bits.

    A task needs a distance matrix. A bucket above `max_bucket` rows is first divided into the components of its graph of pairs
    within the cut, across which complete linkage never merges: pairs of blocks of rows are compared as tasks of their own
    and leave only each row's component there. A component above `max_bucket` rows is an error. Names are unique:
    `<prefix>:<keys>:<number>`, with the component in between where there is one. Rows without a vector of
    `n_bytes` are left out, null keys form a bucket of their own, a repeated id counts once.
    """
    bucket = F.concat_ws("_", *(F.coalesce(F.col(k).cast("string"), F.lit("none")) for k in keys)).alias("bucket")
    rows = df.where(F.length(hv_col) == n_bytes).select(F.col(id_col).alias("id"), bucket, F.col(hv_col).alias("hv")).dropDuplicates(["id"])
    cut, kind = ratio * n_bytes * 8, dict(rows.dtypes)["id"]
    sizes = rows.groupBy("bucket").count()
    large = sizes.where(F.col("count") > max_bucket).select("bucket", F.ceil(2 * F.col("count") / max_bucket).cast("int").alias("parts"))
    if not large.isEmpty():
        block = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        placed = rows.join(large, "bucket").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        side = F.when(F.col("block") == F.col("other"), -1).when(F.col("block") < F.col("other"), 0).otherwise(1)
        pairs = placed.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), side.alias("side"), "id", "hv")
        links = materialise(pairs.groupBy("bucket", "lo", "hi").applyInPandas(lambda pdf: _linked(pdf, cut), f"a {kind}, b {kind}"), "links")
        part = components(rows.join(large, "bucket", "left_semi").select("id"), links, "id", "a", "b").withColumnRenamed("node", "id")
        rows = materialise(rows.join(part, "id", "left").withColumn("bucket", F.concat_ws(":", "bucket", F.col("component").cast("string"))).drop("component"), "parts")
        most = rows.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
        if most > max_bucket:
            raise ValueError(f"{most} rows of a bucket hang together; complete linkage is bounded to {max_bucket}: choose narrower buckets")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        v = _words(pdf["hv"])
        return pd.DataFrame({"id": pdf["id"], "bucket": pdf["bucket"], "n": complete_linkage(_distances(v, v), cut)})

    out = rows.groupBy("bucket").applyInPandas(cluster, f"id {kind}, bucket string, n long")
    return out.select("id", F.concat_ws(":", F.lit(prefix), "bucket", F.col("n").cast("string")).alias("cluster"))


def components(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """(node, component): connected components, each named by its smallest node; nodes without an edge stand alone.

    Alternating large-star and small-star steps: every step attaches nodes to the smallest neighbour they see, until nothing
    changes; each is written to the shared folder. No component is ever gathered in one task.
    """
    spark = nodes.sparkSession
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    path = new_path(spark, "star")
    e = materialise(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "star", path)
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        nxt_path = new_path(spark, "star")
        nxt = materialise(small.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "star", nxt_path)
        state = nxt.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        remove(spark, path)
        e, path = nxt, nxt_path
        if state == last:
            break
        last = state
    parent = e.groupBy("v").agg(F.min("u").alias("component"))
    return nodes.select(F.col(node).alias("node")).where("node IS NOT NULL").distinct().join(parent, F.col("node") == F.col("v"), "left").select("node", F.coalesce("component", "node").alias("component"))


def threshold_components(nodes: DataFrame, pairs: DataFrame, node: str, a: str, b: str, distance: str, thresholds: list[float]) -> DataFrame:
    """(threshold, node, component): components at several distance limits; the distances are computed once by the caller."""
    out = None
    for t in thresholds:
        part = components(nodes, pairs.where(F.col(distance) <= t), node, a, b).withColumn("threshold", F.lit(float(t)))
        out = part if out is None else out.unionByName(part)
    return out


def global_ids(df: DataFrame, cluster: str, prefix: str, out: str) -> DataFrame:
    """Clusters numbered `<prefix>:<n>` in the order of their names. The distinct names are numbered, not the rows, and in
    ranges of names rather than in one task."""
    ranked = numbered(df.select(cluster).distinct(), [F.col(cluster)], "_n")
    return df.join(ranked, cluster).withColumn(out, F.concat(F.lit(f"{prefix}:"), F.col("_n").cast("string"))).drop("_n")

"""Problem 5: the top N items of every group, by statistics-guided skipping over files clustered by group."""

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.plans.lineage import new_path

#: Bytes of a row group of the clustered files; a skipped row group is never decoded.
BLOCK_BYTES = 1 << 20
#: Neighbouring groups whose rows are stored together by descending score, so that a row group below the N-th score of all of
#: them can be skipped even if no group fills one.
TOGETHER = 64
#: Rows of a part of the winners; a merge touches the parts of a row group's own range.
PART_ROWS = 4096


def cluster_files(pairs: DataFrame, path: str, partitions: int | None = None, block_bytes: int = BLOCK_BYTES) -> None:
    """Write (grp, score, item) clustered by buckets of neighbouring groups, best scores first, in small row groups with
    statistics. Range partitioning by bucket and score also divides a group that holds much of the table over several files.
    """
    keys = [F.floor(F.col("grp") / TOGETHER), F.col("score").desc(), F.col("grp"), F.col("item")]
    spread = pairs.repartitionByRange(partitions, *keys) if partitions else pairs.repartitionByRange(*keys)
    spread.sortWithinPartitions(*keys).write.option("parquet.block.size", block_bytes).option("parquet.page.size", max(1024, block_bytes // 8)).option("parquet.block.size.row.check.min", 1000).mode("overwrite").parquet(path)


class Winners:
    """The n best distinct items of every group met so far, in parts sorted by group.

    A row group touches one range of groups, and only the parts in that range are merged: time is linear in the rows read.
    """

    def __init__(self, n: int):
        self.n = n
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.least: list[int] = []

    def _touching(self, lo: int, hi: int) -> slice:
        a = bisect.bisect_left(self.least, lo)
        if a and self.parts[a - 1][0][-1] >= lo:
            a -= 1
        return slice(a, max(a, bisect.bisect_right(self.least, hi)))

    def all_above(self, groups: np.ndarray, top: float) -> bool:
        """Whether each of `groups` (ascending) has n items already, the n-th of them above `top`."""
        part = self.parts[self._touching(int(groups[0]), int(groups[-1]))]
        if not part:
            return False
        grp, score = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
        first, last = np.searchsorted(grp, groups), np.searchsorted(grp, groups, "right") - 1
        return bool((last - first == self.n - 1).all() and (top < score[last]).all())

    def add(self, grp: np.ndarray, score: np.ndarray, item: np.ndarray) -> None:
        """Merge the rows of a row group."""
        where = self._touching(int(grp.min()), int(grp.max()))
        grp, score, item = (np.concatenate([*(p[i] for p in self.parts[where]), x]) for i, x in enumerate((grp, score, item)))
        by = np.lexsort((-score, item, grp))
        grp, score, item = grp[by], score[by], item[by]
        once = np.r_[True, (grp[1:] != grp[:-1]) | (item[1:] != item[:-1])]
        grp, score, item = grp[once], score[once], item[once]
        by = np.lexsort((item, -score, grp))
        grp, score, item = grp[by], score[by], item[by]
        keep = np.arange(len(grp)) - np.searchsorted(grp, grp) < self.n
        grp, score, item = grp[keep], score[keep], item[keep]
        cuts = [0, *np.unique(np.searchsorted(grp, grp[PART_ROWS::PART_ROWS])).tolist(), len(grp)]
        made = [(grp[a:b], score[a:b], item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        self.parts[where] = made
        self.least[where] = [int(p[0][0]) for p in made]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        return tuple(np.concatenate([p[i] for p in self.parts]) for i in range(3))


def scan_file(uri: str, n: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int, int]:
    """The n best of every group of one clustered file; also the row groups read and skipped.

    Row groups are taken in descending maximum score. One is skipped if its maximum is strictly below the current n-th score
    of every group it contains. Its statistics give the maximum and, where smallest and largest group are the same, the only
    group; else, if the groups known between them allow it, the group column alone is read to see which it contains.
    """
    fs, where = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(where) as source:
        file = pq.ParquetFile(source)
        names = [file.schema_arrow.names.index(c) for c in ("grp", "score")]
        stats = []
        for g in range(file.metadata.num_row_groups):
            a, b = (file.metadata.row_group(g).column(c).statistics for c in names)
            known = a is not None and b is not None and a.has_min_max and b.has_min_max
            stats.append((b.max, a.min, a.max, g) if known else (np.inf, None, None, g))
        best, read = Winners(n), 0
        for top, lo, hi, g in sorted(stats, key=lambda x: (-x[0], x[3])):
            # smallest and largest group are contained for certain
            if lo is not None and best.all_above(np.unique([lo, hi]), top):
                groups = np.array([lo]) if lo == hi else np.unique(file.read_row_group(g, columns=["grp"]).column(0).to_numpy())
                if lo == hi or best.all_above(groups, top):
                    continue
            read += 1
            rows = file.read_row_group(g, columns=["grp", "score", "item"])
            if rows.num_rows:
                best.add(*(rows.column(c).to_numpy() for c in ("grp", "score", "item")))
    return best.rows(), read, len(stats) - read


def top_n(df: DataFrame, group_col: str, item_col: str, score_col: str, n: int, partitions: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(group, item, score, place): the n items of highest score of every group, equal scores by smaller item.

    The valid rows are written to the shared folder clustered by group, each task reads one file in descending maximum score
    of its row groups and skips those that can't matter, and the files' winners (at most n a group and file) are merged.

    Rows with a null group or item, or a null or NaN score don't count; an item found several times in a group counts once
    with its highest score. Group and item are integers. Other columns are dropped first. An empty input gives no rows.
    """
    spark = df.sparkSession
    pairs = df.select(F.col(group_col).cast("long").alias("grp"), F.col(score_col).cast("double").alias("score"), F.col(item_col).cast("long").alias("item"))
    pairs = pairs.where(F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    path = new_path(spark, "topn")
    cluster_files(pairs, path, partitions, block_bytes)
    clustered = spark.read.schema("grp long, score double, item long").parquet(path)
    files = spark.createDataFrame([(f,) for f in sorted(clustered.inputFiles())], "uri string")

    def scan(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                (grp, score, item), _, _ = scan_file(uri, n)
                yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(score, pa.float64()), pa.array(item, pa.int64())], names=["grp", "score", "item"])

    best = files.repartition(max(1, len(clustered.inputFiles()))).mapInArrow(scan, "grp long, score double, item long")
    best = best.groupBy("grp", "item").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "item"))
    best = best.withColumn("place", place).where(F.col("place") <= n)
    return best.select(F.col("grp").alias(group_col), F.col("item").alias(item_col), F.col("score").alias(score_col), "place")

"""Problem 3: cutting oversized items at natural boundaries with overlap, by pointer doubling."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.plans.lineage import materialise, new_path, remove


#: White space of every script, as it is taken out of texts.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def successors(starts: np.ndarray, ends: np.ndarray, n: int, limit: int, overlap: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start: forced cuts before the next natural one, and the boundary that one ends at (-1: the text's end).

    Forced cuts follow at a fixed stride, so boundary e comes into reach after floor((e - s - least - 1) / stride) of them, if
    the rest of that division is below limit - least; else it is passed by. The first boundary in reach decides the window,
    the last one of that window is taken. All starts look at their next boundary at once; few need a second or third look.
    """
    stride = limit - overlap
    last = np.maximum(0, -(-(n - limit - starts) // stride))
    forced, end = last.copy(), np.full(len(starts), -1, np.int64)
    at = np.searchsorted(ends, starts + least, "right")
    look = np.flatnonzero(at < len(ends))
    while len(look):
        k, rest = np.divmod(ends[at[look]] - starts[look] - least - 1, stride)
        open_ = k < last[look]
        hit = open_ & (rest < limit - least)
        i = look[hit]
        forced[i] = k[hit]
        end[i] = ends[np.searchsorted(ends, starts[i] + k[hit] * stride + limit, "right") - 1]
        look = look[open_ & ~hit]
        at[look] += 1
        look = look[at[look] < len(ends)]
    return forced, end


def split_points(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int, least: int, gap: str) -> DataFrame:
    """Pieces (id, piece_start, piece_end) of every text longer than `limit` once white space is removed.

    A piece from b ends at the text's end if at most `limit` characters are left; else at the last natural boundary e (the
    offset after a maximal run that matches `gap`) with b + least < e <= b + limit, or at b + limit if there is none. The
    next piece starts `overlap` before that end.

    Candidate starts are 0 and every boundary less the overlap; each is linked to its farthest legal successor, forced cuts
    in between included (see `successors`). The successor tables are squared (start to the 2nd, 4th, 8th next ...) while the
    set of starts reached from 0 doubles, so a text of n pieces takes log2(n) rounds, however many texts there are. Forced
    cuts are laid out last. Time and memory are linear in a text's length and its boundaries.

    Texts that are null, empty, `*` or short give no rows. A repeated id counts once (its longest text, then the greatest).
    A text without boundaries is cut at the stride. Other columns are dropped first. An empty input gives no rows.
    """
    if not 0 <= overlap < least <= limit:
        raise ValueError("need 0 <= overlap < least <= limit")
    spark, stride = df.sparkSession, limit - overlap
    # white space only shortens a text, so most are left out by their length before anything is read of them
    long = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("id").isNotNull() & (F.length("t") > limit))
    kind = dict(long.dtypes)["id"]

    def find_ends(batches):
        pattern = re.compile(gap)
        for batch in batches:
            keep, sizes, ends = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                text = WHITE.sub("", text)
                if len(text) > limit:
                    keep.append(i), sizes.append(len(text)), ends.append([m.end() for m in pattern.finditer(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["id", "n", "ends"])

    found = long.mapInArrow(find_ends, f"id {kind}, n long, ends array<long>")
    items_path = new_path(spark, "items")
    items = materialise(found.groupBy("id").agg(F.max(F.struct("n", "ends")).alias("m")).select("id", "m.n", "m.ends"), "items", items_path)

    def link(batches):
        for batch in batches:
            for key, n, ends in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                e = ends.values.to_numpy()
                s = np.unique(np.concatenate([[0], e[e > overlap] - overlap]))
                k, end = successors(s, e, n, limit, overlap, least)
                natural = end >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(s), key.type), pa.array(s), pa.array([n] * len(s), pa.int64()), pa.array(k), pa.array(end, mask=~natural), pa.array(end - overlap, mask=~natural)], names=["id", "s", "n", "k", "e", "next"]
                )

    links = materialise(items.mapInArrow(link, f"id {kind}, s long, n long, k long, e long, next long"), "links")
    remove(spark, items_path)

    reached, reached_path = links.where("s = 0").select("id", "s"), None
    jump_path = new_path(spark, "jump")
    jump = materialise(links.where("next IS NOT NULL").select("id", "s", "next"), "jump", jump_path)
    while not jump.isEmpty():
        step = reached.join(jump, ["id", "s"]).select("id", F.col("next").alias("s"))
        grown_path = new_path(spark, "reached")
        reached = materialise(reached.unionByName(step).distinct(), "reached", grown_path)
        far = jump.select("id", F.col("s").alias("next"), F.col("next").alias("far"))
        nxt_path = new_path(spark, "jump")
        nxt = materialise(jump.join(far, ["id", "next"]).select("id", "s", F.col("far").alias("next")), "jump", nxt_path)
        remove(spark, jump_path, *([reached_path] if reached_path else []))
        jump, jump_path, reached_path = nxt, nxt_path, grown_path
    remove(spark, jump_path)
    rows = links.join(reached, ["id", "s"])
    pieces = rows.select("id", "n", "s", "k", "e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k"))).alias("i"))
    start = F.col("s") + F.col("i") * stride
    end = F.when(F.col("i") < F.col("k"), start + limit).otherwise(F.coalesce("e", "n"))
    return pieces.select("id", start.cast("long").alias("piece_start"), end.cast("long").alias("piece_end"))

"""Problem 1: the most similar vectors of every vector, by inverted lists and an adaptive dimension scan."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.llm import bitscan

#: Of `sample_rows` rows at most, the lists' leaders are chosen: at most `MAX_LISTS` and those of crowds. All are sample rows, so
#: the broadcast index is under 5 MB.
MAX_LISTS = 16_384
ROWS_A_LIST = 20
CROWD_LISTS = 8
#: The leaders' radius in bits over all bits, and the bits over which rows are compared with leaders.
RADIUS = 600 / 2048
LEADER_WORDS = 8


def usable_vectors(df: DataFrame, id_col: str, hv_col: str, n_bytes: int) -> DataFrame:
    """(id, hv) of rows with an id and a vector of `n_bytes` that is neither all zeros nor all ones."""
    hv = F.col(hv_col)
    return df.select(F.col(id_col).cast("long").alias("id"), hv.alias("hv")).where(
        F.col("id").isNotNull() & hv.isNotNull() & (F.length(hv) == n_bytes) & (hv != F.lit(b"\x00" * n_bytes)) & (hv != F.lit(b"\xff" * n_bytes))
    )


def _matrix(column: pa.Array | pa.ChunkedArray, n_bytes: int) -> np.ndarray:
    """A binary column of equal lengths as (rows, n_bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    size = 8 if pa.types.is_large_binary(column.type) else 4
    first = int(np.frombuffer(column.buffers()[1], np.int64 if size == 8 else np.int32, 1, column.offset * size)[0]) if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", np.uint8, len(column) * n_bytes, first).reshape(-1, n_bytes)


def choose_leaders(sample: np.ndarray, n_lists: int, weight: float, cap: float) -> np.ndarray:
    """Leaders of the lists from rotated sample rows.

    A leader takes the unclaimed sample rows within the radius. Where that stands for more than `cap` rows (each sample row
    for `weight`), the radius is halved there, so that a crowd of like vectors gets many leaders instead of one long list.
    Outside crowds at most `n_lists` leaders are chosen; every crowd has `CROWD_LISTS` more for each `cap` rows it stands
    for. All rows are looked at even when the leaders are used up, since a crowd may still come.
    """
    words = sample[:, : min(LEADER_WORDS, sample.shape[1])]
    bits = words.shape[1] * 64
    chosen: list[int] = []
    todo = [(np.arange(len(sample)), RADIUS * bits, n_lists)]
    while todo:
        rows, radius, budget = todo.pop()
        part = np.ascontiguousarray(words[rows].T)
        while len(rows) and (budget > 0 or len(rows) * weight > cap):
            near = np.bitwise_count(part ^ part[:, :1]).sum(axis=0, dtype=np.int32) <= radius
            taken = rows[near]
            if len(taken) * weight > cap and radius >= 16 and len(taken) > 1:
                todo.append((taken, radius / 2, int(np.ceil(CROWD_LISTS * len(taken) * weight / cap))))
            elif budget > 0:
                chosen.append(int(rows[0]))
                budget -= 1
            rows, part = (rows[1:], part[:, 1:]) if len(taken) == 1 else (rows[~near], part[:, ~near])
    return words[np.array(chosen, np.int64)]


def _signs(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little").astype(np.float32) * 2 - 1


class Lists:
    """Which lists a row enters: those of its `probes` nearest leaders. If one is so near that the row belongs to its family, only
    those that are so near (a crowd has several) and at least `near_probes`: its neighbours enter the same ones."""

    def __init__(self, leaders: np.ndarray, probes: int, near_probes: int):
        self.leaders, self.near_probes = leaders, near_probes
        self.probes = min(probes, len(leaders))
        signs = _signs(leaders)
        # the leaders in blocks: only the blocks of the `probes` greatest maxima can hold a row's nearest leaders
        self.block = 64 if len(leaders) > 64 * 2 * self.probes else len(leaders)
        self.signs = np.zeros((signs.shape[1], -(-len(leaders) // self.block) * self.block), np.float32)
        self.signs[:, : len(leaders)] = signs.T

    def of(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for rotated rows."""
        rows, lists, p = [], [], self.probes
        bits = self.signs.shape[0]
        for i in range(0, len(packed), 1024):
            score = _signs(packed[i : i + 1024, : self.leaders.shape[1]]) @ self.signs
            score[:, len(self.leaders) :] = -bits - 1
            cut = score.reshape(len(score), -1, self.block)
            if cut.shape[1] > 1:
                most = cut.max(axis=2)
                blocks = np.argpartition(most, -p, axis=1)[:, -p:]
                score = np.take_along_axis(cut, blocks[:, :, None], axis=1).reshape(len(score), -1)
                names = (blocks[:, :, None] * self.block + np.arange(self.block)).reshape(len(score), -1)
            else:
                names = np.broadcast_to(np.arange(self.block), score.shape)
            top = np.argpartition(score, -p, axis=1)[:, -p:]
            got = np.take_along_axis(score, top, axis=1)
            by = np.argsort(-got, axis=1, kind="stable")
            got, top = np.take_along_axis(got, by, axis=1), np.take_along_axis(names, np.take_along_axis(top, by, axis=1), axis=1)
            near = (got >= bits * (1 - 2 * RADIUS)).sum(axis=1)
            keep = np.arange(p)[None, :] < np.where(near > 0, np.maximum(near, self.near_probes), p)[:, None]
            r, c = np.nonzero(keep)
            rows.append(r + i), lists.append(top[r, c])
        return (np.concatenate(rows), np.concatenate(lists)) if rows else (np.empty(0, np.int64),) * 2


def scan_list(vec: np.ndarray, k: int, limit: int, fine_rows: int, probes: int, near_probes: int):
    """(place, other place, distance) of the k nearest of every rotated row of one list, ascending in id.

    A list of more than `fine_rows` rows, as they come where the number of lists has its bound, is divided once more by
    leaders of its own, so that the work stays linear in its rows.
    """
    n = len(vec)
    if n <= fine_rows:
        return nearest_within(vec, np.arange(n), k, limit)
    n_lists = max(1, min(n // ROWS_A_LIST, 4096))
    sample = np.random.default_rng(n).permutation(n)[: 3 * n_lists]
    inner = Lists(choose_leaders(vec[sample], n_lists, n / len(sample), fine_rows), probes, near_probes)
    row, name = inner.of(vec)
    by = np.argsort(name, kind="stable")
    row, cut = row[by], np.flatnonzero(np.diff(name[by])) + 1
    found = [nearest_within(vec, np.sort(part), k, limit) for part in np.split(row, cut)]
    i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((j, d, i))
    i, j, d = i[by], j[by], d[by]
    once = np.r_[True, (np.diff(i) != 0) | (np.diff(j) != 0)][: len(i)]
    i, j, d = i[once], j[once], d[once]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best], j[best], d[best]


def nearest_within(vec: np.ndarray, rows: np.ndarray, k: int, limit: int):
    part = vec[rows]
    i, j, d = bitscan.nearest(part, part, k, limit, True)
    return rows[i], rows[j], d


def nearest_neighbours(
    df: DataFrame,
    id_col: str,
    hv_col: str,
    k: int = 10,
    max_distance: int = 700,
    n_bytes: int = 256,
    probes: int = 11,
    near_probes: int = 2,
    list_cap: int = 8192,
    max_lists: int = MAX_LISTS,
    split_rows: int = 65_536,
    seed: int = 7,
) -> DataFrame:
    """For every usable vector, its k nearest others within `max_distance` bits: (id, other, distance).

    A leader index is fitted on at most 3 * `max_lists` rows; every row goes into the lists of its `probes` nearest leaders
    (fewer if its own family has leaders, see `Lists`), and each list is scanned by itself with the adaptive dimension scan. Regions of more than `list_cap` rows get leaders of their own. Once `max_lists` is reached, lists
    grow with the data: those above `list_cap` rows are divided again by leaders of their own in their task. A list that
    the sample expects to hold more than `split_rows` rows is cut into blocks by id, and every pair of blocks is a group of
    its own, so no task holds more than about two blocks and no pair of the list is lost. Of more than k + 1
    equal vectors only the k + 1 smallest ids enter the lists; the others' neighbours are the k smallest ids of their group.
    Null ids, null or unusable vectors are left out; a repeated id counts once (with different vectors, by its nearest);
    equal distances go by smaller id; an empty input gives an empty result. Other columns are never read.
    """
    spark = df.sparkSession
    vectors = usable_vectors(df, id_col, hv_col, n_bytes)
    total = vectors.count()
    n_lists = int(max(1, min(total // ROWS_A_LIST, max_lists)))
    want = max(64, 3 * n_lists)
    share = min(1.0, 1.3 * want / max(total, 1))
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000_000))
    # By hash, not the first rows: a crowd at the end of the table must be in the sample as well.
    picked = vectors.where(place < int(share * 1_000_000_000) + 1).orderBy(place, "id").select("hv").limit(want)
    order = bitscan.rotation(n_bytes * 8, seed)
    sample = bitscan.rotate(_matrix(picked.toArrow()["hv"], n_bytes), order)
    if total and not len(sample):
        sample = bitscan.rotate(_matrix(vectors.select("hv").limit(64).toArrow()["hv"], n_bytes), order)
    weight = total / max(len(sample), 1)
    leaders = choose_leaders(sample, n_lists, weight, list_cap) if len(sample) else np.empty((0, 1), np.uint64)
    parts = np.ones(len(leaders), np.int64)
    if total > split_rows:
        parts = np.maximum(1, np.ceil(np.bincount(Lists(leaders, probes, near_probes).of(sample)[1], minlength=len(leaders)) * weight / split_rows)).astype(np.int64)
    index = spark.sparkContext.broadcast((leaders, order, parts))

    # Copies beyond the first k + 1 of a vector can't change any result but their own.
    groups = vectors.select("id", F.xxhash64("hv").alias("h1"), F.xxhash64(F.lit(1), "hv").alias("h2")).distinct()
    ranked = groups.withColumn("copy", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id")))
    first = ranked.where(F.col("copy") <= k + 1)
    crowded = first.where(F.col("copy") == k + 1).select("h1", "h2")
    excess = groups.join(crowded, ["h1", "h2"]).join(first.select("h1", "h2", "id", "copy"), ["h1", "h2", "id"], "left").where(F.col("copy").isNull()).select("h1", "h2", "id")
    has_excess = not crowded.isEmpty()
    scanned = vectors.join(excess.select("id"), "id", "left_anti") if has_excess else vectors

    def assign(batches):
        lead, bit_order, blocks = index.value
        lists = Lists(lead, probes, near_probes) if len(lead) else None
        for batch in batches:
            if not batch.num_rows or lists is None:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            packed = bitscan.rotate(_matrix(batch.column(1), n_bytes), bit_order)
            for i in range(0, len(ids), 1024):
                row, name = lists.of(packed[i : i + 1024])
                # block b of a list of n blocks meets block o in the pair (least, greatest); the lesser has side 0, b = o side -1
                n = blocks[name]
                mine = (ids[i : i + 1024][row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                row, name, mine, n = (np.repeat(x, n) for x in (row, name, mine, n))
                run = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(name) != 0)])
                other = np.arange(len(n)) - np.repeat(run, np.diff(np.r_[run, len(n)]))
                pair = np.minimum(mine, other) * n + np.maximum(mine, other)
                side = np.where(mine == other, -1, (mine > other).astype(np.int64))
                flat = np.ascontiguousarray(packed[i : i + 1024][row])
                offsets = pa.py_buffer((np.arange(len(row) + 1, dtype=np.int32) * n_bytes).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(side.astype(np.int8)), pa.array(ids[i : i + 1024][row]), pa.Array.from_buffers(pa.binary(), len(row), [None, offsets, pa.py_buffer(flat)])],
                    names=["list", "pair", "side", "id", "hv"],
                )

    def scan(tbl: pa.Table) -> pa.Table:
        ids, side = tbl.column("id").to_numpy(), tbl.column("side").to_numpy()
        vec = np.ascontiguousarray(_matrix(tbl.column("hv"), n_bytes)).view(np.uint64)
        rank = np.argsort(ids, kind="stable")
        ids, vec, side = ids[rank], vec[rank], side[rank]
        if len(ids) > 1:
            same = np.zeros(len(ids), bool)
            same[1:] = (ids[1:] == ids[:-1]) & (vec[1:] == vec[:-1]).all(axis=1)
            ids, vec, side = ids[~same], vec[~same], side[~same]
        if len(side) and side.max() < 0:
            i, j, d = scan_list(vec, k, max_distance, max(list_cap, 1), probes, near_probes)
        else:
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            i, j, d = bitscan.nearest(vec[a], vec[b], k, max_distance, False)
            x, y, e = bitscan.nearest(vec[b], vec[a], k, max_distance, False)
            i, j, d = np.concatenate([a[i], b[x]]), np.concatenate([b[j], a[y]]), np.concatenate([d, e])
        return pa.table({"id": pa.array(ids[i], pa.int64()), "other": pa.array(ids[j], pa.int64()), "distance": pa.array(d.astype(np.int32))})

    listed = scanned.mapInArrow(assign, "list int, pair int, side byte, id long, hv binary")
    found = listed.groupBy("list", "pair").applyInArrow(scan, "id long, other long, distance int")
    by = Window.partitionBy("id").orderBy("distance", "other")
    best = found.where(F.col("id") != F.col("other")).groupBy("id", "other").agg(F.min("distance").alias("distance"))
    best = best.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).drop("place")
    if has_excess:
        copies = excess.join(first.where(F.col("copy") <= k).select("h1", "h2", F.col("id").alias("other")), ["h1", "h2"])
        best = best.unionByName(copies.select("id", "other", F.lit(0).alias("distance")))
    return best


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """Undirected pairs (a < b) of a directed neighbour table, each once."""
    return neighbours.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "distance").groupBy("a", "b").agg(F.min("distance").alias("distance"))

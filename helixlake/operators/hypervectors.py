"""Hypervector codebooks and encoders, exact top-k by Hamming similarity, and the coarse filter."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors of one pass; more are searched in several blocks, so that what is broadcast stays bounded.
QUERY_BLOCK = 20_000


def _flip_walk(rows: int, dim: int, step: int, rng: np.random.Generator) -> np.ndarray:
    """(rows, dim) bits of a walk: from a random vector, every row turns the next `step` positions of a random order that
    starts anew at its end. A position of place r in the order has been turned ceil((i * step - r) / dim) times in row i."""
    place = np.argsort(rng.permutation(dim))
    turned = -((place[None, :] - step * np.arange(rows)[:, None]) // dim)
    return (rng.integers(0, 2, dim, np.uint8)[None, :] ^ (turned & 1)).astype(np.uint8)


def position_codebook(bins: int, dim: int, seed: int, kind: str = "random", flip_bits: int = 8) -> np.ndarray:
    """(bins, dim / 8) packed position vectors: independent bits, or neighbours that differ in `flip_bits` bits."""
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (bins, dim), np.uint8) if kind == "random" else _flip_walk(bins, dim, flip_bits, rng)
    return np.packbits(bits, axis=1, bitorder="little")


def level_codebook(levels: int, dim: int, seed: int, kind: str = "random") -> np.ndarray:
    """(levels, dim) bits: the first l / (Q - 1) * dim / 2 bits of a half-and-half vector turned, or a walk of equal steps."""
    if kind != "random":
        return _flip_walk(levels, dim, max(1, dim // levels), np.random.default_rng(seed + 1))
    at = np.arange(dim)[None, :]
    turned = (np.arange(levels) / max(levels - 1, 1) * dim / 2).astype(np.int64)[:, None]
    return ((at >= dim // 2) ^ (at < turned)).astype(np.uint8)


def gaussian_codebooks(bins: int, levels: int, dim: int, seed: int, flip_factor: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Position vectors from one Gaussian vector: at each step the signs at dim / flip_factor drawn positions are turned, one
    drawn twice as well. levels + 1 level vectors of +1 and -1, from a half-and-half vector by turning its head further."""
    rng = np.random.default_rng(seed)
    half = rng.permutation(np.repeat([-1.0, 1.0], [dim // 2, dim - dim // 2]))
    head = (np.arange(levels + 1) / levels * dim).astype(np.int64) // 2
    level = np.where(np.arange(dim)[None, :] < head[:, None], -half, half)
    start = rng.normal(0, 1, dim)
    turned = np.zeros((bins, dim), bool)
    turned[np.arange(1, bins)[:, None], rng.integers(0, dim, (max(bins - 1, 0), dim // flip_factor))] = True
    signs = 1.0 - 2.0 * (np.cumsum(turned, axis=0) % 2)
    return (start * signs).astype(np.float32), level.astype(np.float32)


@dataclass(frozen=True)
class Encoder:
    """How a peak list becomes a packed vector. `style`: weighted (half-even levels, weight level + 1, ties +1), bipolar
    (bin = whole m/z, truncated levels, ties +1, empty gives zeros) or aligned (levels + 1, ties -1, empty gives all -1)."""

    style: str = "weighted"
    dim: int = 2048
    levels: int = 16
    start: float = 0.0
    bin_size: float = 1.0
    bins: int = 2000
    seed: int = 42
    kind: str = "random"
    flip_bits: int = 8

    def codebooks(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and levels as +1 / -1 (Gaussian positions for `aligned`)."""
        if self.dim % 8 or self.levels < 2 or self.bins < 1 or self.bin_size <= 0:
            raise ValueError("dim must be a multiple of 8, levels at least 2, bins and bin_size positive")
        if self.style == "aligned":
            return gaussian_codebooks(self.bins, self.levels, self.dim, self.seed)
        position = np.unpackbits(position_codebook(self.bins, self.dim, self.seed, self.kind, self.flip_bits), axis=1, bitorder="little")
        return 1.0 - 2.0 * position.astype(np.float32), 1.0 - 2.0 * level_codebook(self.levels, self.dim, self.seed, self.kind).astype(np.float32)

    def encode(self, mz: np.ndarray, intensity: np.ndarray, position: np.ndarray, level: np.ndarray) -> bytes:
        zero, top = bytes(self.dim // 8), float(intensity.max()) if len(intensity) else 0.0
        if top <= 0:
            return zero
        keep = intensity >= 0
        place = np.floor((mz - self.start) / (1.0 if self.style == "bipolar" else self.bin_size)).astype(np.int64)
        keep &= (place >= 0) & (place < self.bins)
        share = intensity / top if self.style != "aligned" or top > 1 else intensity
        if self.style == "weighted":
            # intensities of one bin are added up before they are scaled
            used, where = np.unique(place[keep], return_inverse=True)
            total = np.bincount(where, intensity[keep], len(used))
            if not len(used):
                return zero
            grade = np.clip(np.rint(total / total.max() * (self.levels - 1)), 0, self.levels - 1).astype(np.int64)
            added = ((position[used] * level[grade]) * (grade + 1)[:, None]).sum(axis=0)
            return np.packbits(added >= 0, bitorder="little").tobytes()
        most = self.levels - 1 if self.style == "bipolar" else self.levels
        grade = np.clip((share * most).astype(np.int64), 0, most)[keep]
        added = (position[place[keep]] * level[grade]).sum(axis=0)
        return np.packbits(added >= 0 if self.style == "bipolar" else added > 0, bitorder="little").tobytes()


def encode(df: DataFrame, id_col: str, mz: str, intensity: str, encoder: Encoder, out: str = "hv") -> DataFrame:
    """(id, hv): every spectrum encoded, in Arrow batches; null or empty peak lists give the encoder's empty vector."""
    kind = dict(df.select(F.col(id_col).alias("id")).dtypes)["id"]
    books = df.sparkSession.sparkContext.broadcast(encoder.codebooks())

    def run(batches):
        position, level = books.value
        for batch in batches:
            vectors = [
                encoder.encode(np.array(m or [], np.float64), np.array(i or [], np.float64), position, level) for m, i in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], names=["id", out])

    return df.select(F.col(id_col).alias("id"), F.expr(mz).alias("m"), F.expr(intensity).alias("i")).mapInArrow(run, f"id {kind}, {out} binary")


def _rows(column, n_bytes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, n_bytes // 8)


def _differing(a: np.ndarray, b: np.ndarray, room: list[np.ndarray]) -> np.ndarray:
    """(rows of a, columns of b) differing bits of `a` (n, words) and `b` (words, m); the result lies in `room` until the next call."""
    x, ones, few, out = (r[: len(a), : b.shape[1]] for r in room)
    out[:] = 0
    for at in range(0, len(b), 3):
        # three words differ in 192 bits at most, which one byte holds
        for w in range(at, min(at + 3, len(b))):
            np.bitwise_xor(a[:, w, None], b[None, w], out=x)
            np.bitwise_count(x, out=few if w == at else ones)
            if w > at:
                np.add(few, ones, out=few)
        np.add(out, few, out=out)
    return out


def nearest_rows(vec: np.ndarray, batches, k: int, n_bytes: int, tile: int = 4096, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(items, distances), a row for every row of `vec` (n, words): its k rows of (item, vector) batches, or all if there are fewer,
    with the fewest differing bits, then smallest item. Compared are `rows` x `tile` vectors at a time, and only
    pairs that enter a query's list leave that square, so what is held beyond the lists depends on neither input's size."""
    bits = 8 * n_bytes
    kind = np.min_scalar_type(bits + 1)
    best_d, best_i, width = np.empty((len(vec), 0), kind), np.empty((len(vec), 0), np.int64), 0
    room = [np.empty((rows, tile), t) for t in (np.uint64, np.uint8, np.uint8, kind)]
    for batch in batches:
        items, refs = batch.column(0).to_numpy(), _rows(batch.column(1), n_bytes)
        for t in range(0, len(items) if k > 0 else 0, tile):
            names, turned = items[t : t + tile], np.ascontiguousarray(refs[t : t + tile].T)
            free = ((0, 0), (0, min(k - width, len(names))))  # filled by this tile
            best_d, best_i = np.pad(best_d, free, constant_values=bits + 1), np.pad(best_i, free, constant_values=np.iinfo(np.int64).max)
            width = best_d.shape[1]
            for at in range(0, len(vec), rows):
                d = _differing(vec[at : at + rows], turned, room)
                old_d, old_i = best_d[at : at + rows], best_i[at : at + rows]
                last, name = old_d[:, -1], old_i[:, -1]
                if len(names) > width and last.max() > bits:
                    last = np.minimum(last, np.partition(d, width - 1, axis=1)[:, width - 1])
                i, j = np.nonzero(d <= last[:, None])
                ok = (d[i, j] < old_d[i, -1]) | (names[j] < name[i])
                i, j = i[ok], j[ok]
                if len(i):
                    who, far, what = np.concatenate([np.repeat(np.arange(len(d)), width), i]), np.concatenate([old_d.ravel(), d[i, j]]), np.concatenate([old_i.ravel(), names[j]])
                    by = np.lexsort((what, far, who))
                    by = by[np.arange(len(by)) - np.searchsorted(who[by], who[by]) < width]
                    best_d[at : at + rows], best_i[at : at + rows] = far[by].reshape(-1, width), what[by].reshape(-1, width)
    return best_i, best_d


def top_k(df: DataFrame, queries: DataFrame, id_col: str, hv_col: str, k: int, n_bytes: int, least: int | None = None, tile: int = 4096) -> DataFrame:
    """(query, item, similarity, place): the k rows of highest Hamming similarity (equal bits) to every query, then smallest id.

    The stated query set is collected in blocks of `QUERY_BLOCK` and broadcast; every task keeps the k best of each query over
    its rows, tile by tile, and the tasks' lists are merged. Rows with a null or differently long vector don't take part; a
    query finds itself too. k is clamped to the number of rows. `least` leaves out similarities below it.
    """
    usable = F.length(hv_col) == n_bytes
    rows = df.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(hv_col).alias("hv"))
    asked = queries.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query"), F.col(hv_col).alias("hv")).dropDuplicates(["query"])
    blocks, out = max(1, -(-asked.count() // QUERY_BLOCK)), None
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).orderBy("query").toArrow()
        data = df.sparkSession.sparkContext.broadcast((got["query"].to_numpy(), _rows(got["hv"], n_bytes)))

        def scan(batches, data=data):
            ids, vec = data.value
            found, far = nearest_rows(vec, batches, k, n_bytes, tile)
            for at in range(0, len(ids), 1024):
                part = found[at : at + 1024]
                who, same = np.repeat(ids[at : at + 1024], part.shape[1]), 8 * n_bytes - far[at : at + 1024].astype(np.int32).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(part.ravel()), pa.array(same)], names=["query", "item", "similarity"])

        part = rows.mapInArrow(scan, "query long, item long, similarity int")
        out = part if out is None else out.unionByName(part)
    out = out.distinct() if least is None else out.where(F.col("similarity") >= least).distinct()
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "item"))
    return out.withColumn("place", place).where(F.col("place") <= k)


def prefix_similarity(a: Column, b: Column, segments: int, words_a_segment: int) -> Column:
    """Equal bits over the first `segments` segments of two arrays of 64-bit words."""
    n = segments * words_a_segment
    return F.lit(64 * n) - F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def coarse_filter(pairs: DataFrame, partial: str, examined_bits: int, dim: int, threshold: Column) -> DataFrame:
    """Pairs that may still reach the threshold: equal bits so far plus all bits not yet examined. Never loses one that does."""
    return pairs.where(F.col(partial) + (dim - examined_bits) >= threshold)


def filtered_similarity(pairs: DataFrame, a: Column, b: Column, words: int, bits_a_word: int, dim: int, threshold: Column, out: str = "similarity") -> DataFrame:
    """Pairs that may reach `threshold`, with their similarity of all `dim` bits. The first `words` words of both vectors are
    compared for every pair, the others only where equal bits so far and all bits left could still make it."""
    n = words * bits_a_word
    if dim % 8 or words < 0 or bits_a_word < 1 or n > dim:
        raise ValueError(f"{words} words of {bits_a_word} bits don't fit {dim} bits, a multiple of 8")
    equal = lambda x, y, bits: F.lit(bits) - F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    kept = coarse_filter(pairs.withColumn("_part", equal(F.slice(a, 1, words), F.slice(b, 1, words), n)), "_part", n, dim, threshold)
    rest = equal(F.slice(a, words + 1, 2**30), F.slice(b, words + 1, 2**30), dim - n)
    return kept.withColumn(out, F.col("_part") + rest).drop("_part")


def candidate_reduction(unfiltered: Column, surviving: Column) -> Column:
    """1 - surviving / unfiltered; 0 without candidates."""
    return F.when(unfiltered > 0, 1.0 - surviving / unfiltered).otherwise(0.0)

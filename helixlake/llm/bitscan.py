"""Adaptive dimension scan over packed bit vectors.

The rotation is a seeded permutation of the bits: an orthogonal map that keeps vectors packed and distances equal. After
it, every block of columns is a random sample of the bits, so the distance over the first m bits of a pair at distance t
is hypergeometric. A pair is given up as soon as its partial distance is too large for "distance <= t" to be believed.
"""

import numpy as np

#: Standard errors beyond which a candidate is given up; a true one is lost with a chance of about 2 in 10,000 a test.
Z = 3.5
#: Words of 64 bits after which the test is made.
STOPS = (4, 8, 16)


def rotation(bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(bits)


def rotate(packed: np.ndarray, order: np.ndarray) -> np.ndarray:
    """(n, bytes) uint8 to (n, words) uint64 with the bits in `order`."""
    out = np.empty((len(packed), packed.shape[1] // 8), np.uint64)
    for i in range(0, len(packed), 4096):
        bits = np.unpackbits(packed[i : i + 4096], axis=1, bitorder="little")
        out[i : i + 4096] = np.ascontiguousarray(np.packbits(np.take(bits, order, axis=1), axis=1, bitorder="little")).view(np.uint64)
    return out


def critical(words: int, limit, total: int, z: float = Z):
    """The largest partial distance over `words` words that fits a full distance of `limit`."""
    m, n = words * 64, total * 64
    p = np.asarray(limit, np.float64) / n
    return np.floor(m * p + z * np.sqrt(np.maximum(m * p * (1 - p) * (n - m) / max(n - 1, 1), 0)) + 0.5)


def _partial(a: np.ndarray, b: np.ndarray, lo: int, hi: int) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(lo, hi):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def _pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return np.bitwise_count(a[i, lo:hi] ^ b[j, lo:hi]).sum(axis=1, dtype=np.int32)


def survivors(a: np.ndarray, b: np.ndarray, limit: np.ndarray, z: float = Z):
    """Pairs (i, j, distance) of rows of `a` and `b` with distance <= limit[i], by the adaptive scan."""
    total = a.shape[1]
    stops = [s for s in STOPS if s < total] + [total]
    acc, at = _partial(a, b, 0, stops[0]), stops[0]
    stop = 0
    while at < total:
        alive = acc <= critical(at, limit, total, z)[:, None]
        if alive.mean() < 0.1:
            break
        stop += 1
        acc += _partial(a, b, at, stops[stop])
        at = stops[stop]
    if at == total:
        i, j = np.nonzero(acc <= limit[:, None])
        return i, j, acc[i, j].astype(np.int32)
    i, j = np.nonzero(alive)
    d = acc[i, j].astype(np.int32)
    for nxt in stops[stop + 1 :]:
        keep = d <= critical(at, limit, total, z)[i]
        i, j, d = i[keep], j[keep], d[keep]
        d = d + _pairs(a, b, i, j, at, nxt)
        at = nxt
    keep = d <= limit[i]
    return i[keep], j[keep], d[keep]


def nearest(q: np.ndarray, c: np.ndarray, k: int, limit: int, own: bool, rows: int = 256, cols: int = 2048):
    """Of every row of `q`, the k rows of `c` of smallest distance (then smallest place) within `limit`: place in q, place in
    c, distance. With `own`, both are the same rows and none is its own neighbour.

    The columns are read in blocks; after each, a query's limit falls to its k-th best.
    """
    n, out = len(c), []
    for r in range(0, len(q), rows):
        part = q[r : r + rows]
        best = np.empty((len(part), 0), np.int64)
        lim = np.full(len(part), limit, np.int64)
        for at in range(0, n, cols):
            i, j, d = survivors(part, c[at : at + cols], lim)
            j = j + at
            if own:
                ok = i + r != j
                i, j, d = i[ok], j[ok], d[ok]
            if not len(i):
                continue
            most = int(np.bincount(i, minlength=len(part)).max())
            start = np.zeros(len(part) + 1, np.int64)
            np.cumsum(np.bincount(i, minlength=len(part)), out=start[1:])
            grid = np.full((len(part), best.shape[1] + most), np.iinfo(np.int64).max)
            grid[:, : best.shape[1]] = best
            grid[i, best.shape[1] + np.arange(len(i)) - start[i]] = d.astype(np.int64) * n + j
            if grid.shape[1] > k:
                grid = np.partition(grid, k - 1, axis=1)[:, :k]
                worst = grid.max(axis=1)
                full = worst < np.iinfo(np.int64).max
                lim[full] = np.minimum(lim[full], worst[full] // n)
            best = grid
        i, s = np.nonzero(best < np.iinfo(np.int64).max)
        key = best[i, s]
        out.append((i + r, key % n, key // n))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))

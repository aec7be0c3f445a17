"""Problem 6: filling containers of fixed capacity with texts, by linear grouping and configurations of few sizes."""

import base64
import bisect
import os

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.plans.lineage import materialise

# Fixed value: the split pattern of the public byte-level BPE vocabulary.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Items of one size are numbered in hash buckets of about this many, so that a size that most rows share isn't one task's work.
BUCKET_ROWS = 100_000
#: Rows up to which the tables of flows and of bucket offsets are broadcast; beyond, they are joined by size.
BROADCAST_ROWS = 200_000


def load_tokenizer(path: str = TOKENIZER_FILE):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """An optimal fractional choice of configurations (how many of each size a container holds) that covers the demand.

    Column generation: revised simplex over the configurations met so far; the next one is the best knapsack filling at the
    current dual prices, by dynamic programming over the number of items.
    """
    k = len(sizes)
    if not k:
        return []
    size = np.array(sizes)
    basis = np.diag(capacity // size).astype(float)
    inverse = np.diag(1.0 / (capacity // size))
    x = inverse @ np.array(demand, float)
    most = int(capacity // size.min())
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        value, back = np.zeros((most + 1, capacity + 1)), np.full((most + 1, capacity + 1), -1)
        for j in range(1, most + 1):
            value[j] = value[j - 1]
            for i in range(k):
                s = sizes[i]
                gain = value[j - 1, : capacity + 1 - s] + price[i]
                better = gain > value[j, s:] + 1e-12
                value[j, s:][better], back[j, s:][better] = gain[better], i
        if value[most, capacity] <= 1 + 1e-7:
            break
        new, j, c = np.zeros(k), most, capacity
        while j:
            i = back[j, c]
            if i >= 0:
                new[i] += 1
                c -= sizes[i]
            j -= 1
        move = inverse @ new
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = new
        row = inverse[out] / move[out]
        inverse = inverse - np.outer(move, row)
        inverse[out] = row
        x = np.maximum(inverse @ np.array(demand, float), 0)
    return [(basis[:, i].astype(int), float(x[i])) for i in range(k) if x[i] > 1e-9]


def pack_histogram(counts: dict[int, int], capacity: int, groups: int = 24, large: float = 1 / 8) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Flows (size, first rank, last rank + 1, first container, items a container) and the number of containers.

    `counts` is how many items have each size from 1 to `capacity`; items of a size are ranked from 0. Sizes above
    `large` * capacity are sorted and cut into `groups` groups of equal cardinality, each rounded up to its largest size;
    configurations of the rounded sizes are optimised and rounded down; the actual items take their places; what is left
    over and the small items go, largest first, to the container with the least space that holds them. Work and memory
    depend on the number of sizes, not of items.
    """
    flows: list[tuple[int, int, int, int, int]] = []
    left = {s: [0, n] for s, n in counts.items() if n > 0}
    made = 0
    free: dict[int, list[tuple[int, int]]] = {}

    def room(space: int, lo: int, hi: int) -> None:
        if hi > lo and space > 0:
            if space not in free:
                bisect.insort(levels, space)
                free[space] = []
            free[space].append((lo, hi))

    levels: list[int] = []
    if capacity in left:
        n = left.pop(capacity)[1]
        flows.append((capacity, 0, n, 0, 1))
        made = n
    big = sorted((s for s in left if s > large * capacity), reverse=True)
    total = sum(left[s][1] for s in big)
    if total:
        share = -(-total // min(groups, total))
        runs, seen = [], 0  # (group, size, items) in descending size
        for s in big:
            n = left[s][1]
            while n:
                take = min(n, share - seen % share)
                runs.append((seen // share, s, take))
                seen += take
                n -= take
        members: dict[int, list[list[int]]] = {}
        start = {s: 0 for s in big}
        for g, s, n in runs:
            members.setdefault(g, []).append([s, start[s], n])
            start[s] += n
        rounded = [members[g][0][0] for g in sorted(members)]
        demand = [sum(m[2] for m in members[g]) for g in sorted(members)]
        queues = [list(reversed(members[g])) for g in sorted(members)]
        for config, times in configurations(rounded, demand, capacity):
            times = int(times + 1e-6)
            times = min([times] + [sum(m[2] for m in queues[g]) // int(c) for g, c in enumerate(config) if c])
            if times < 1:
                continue
            cuts, columns = {0, times}, []
            for g, c in enumerate(config):
                for _ in range(int(c)):
                    at = 0
                    while at < times:
                        s, rank, n = queues[g][-1]
                        take = min(n, times - at)
                        columns.append((at, at + take, s))
                        flows.append((s, rank, rank + take, made + at, 1))
                        queues[g][-1][1] += take
                        queues[g][-1][2] -= take
                        if not queues[g][-1][2]:
                            queues[g].pop()
                        at += take
                        cuts.add(at)
            edges = np.array(sorted(cuts))
            used = np.zeros(len(edges) - 1, np.int64)
            for lo, hi, s in columns:
                used[np.searchsorted(edges, lo) : np.searchsorted(edges, hi)] += s
            for lo, hi, u in zip(edges[:-1].tolist(), edges[1:].tolist(), used.tolist(), strict=True):
                room(capacity - u, made + lo, made + hi)
            made += times
        rest: dict[int, list[tuple[int, int]]] = {}
        for queue in queues:
            for s, rank, n in queue:
                if n:
                    rest.setdefault(s, []).append((rank, rank + n))
    else:
        rest = {}
    for s in left:
        if s not in big:
            rest[s] = [(0, left[s][1])]
    for s in sorted(rest, reverse=True):
        for rank, end in rest[s]:
            while rank < end:
                at = bisect.bisect_left(levels, s)
                if at == len(levels):
                    need = -(-(end - rank) // (capacity // s))
                    room(capacity, made, made + need)
                    made += need
                    at = bisect.bisect_left(levels, s)
                space = levels[at]
                lo, hi = free[space].pop()
                if not free[space]:
                    del free[space], levels[at]
                each = space // s
                whole = min(hi - lo, (end - rank) // each)
                if whole:
                    flows.append((s, rank, rank + whole * each, lo, each))
                    room(space - each * s, lo, lo + whole)
                    rank += whole * each
                    room(space, lo + whole, hi)
                else:
                    flows.append((s, rank, end, lo, end - rank))
                    room(space - (end - rank) * s, lo, lo + 1)
                    room(space, lo + 1, hi)
                    rank = end
    return flows, made


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, tokenizer_file: str = TOKENIZER_FILE, groups: int = 24, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, piece, token_start, token_end, n_tokens, container): the container of every text or piece of a text.

    Texts are counted in tokens of the vocabulary in `tokenizer_file`, which the driver sends to the executors; only texts above `capacity` are cut, into pieces of
    exactly `capacity` tokens and a rest. The driver sees the number of items of each size (at most `capacity` numbers) and
    returns flows of ranks; every item is numbered within its size and placed by its flow. No container is exceeded.

    Null and empty texts get one row with 0 tokens and a null container. Equal texts are placed each by itself; a repeated
    id is placed as often as it occurs. Other columns are dropped first. An empty input gives no rows.
    """
    spark = df.sparkSession
    spark.sparkContext.addFile(tokenizer_file)
    file_name = os.path.basename(tokenizer_file)

    def tokens(batches):
        tokenizer = load_tokenizer(SparkFiles.get(file_name))
        for batch in batches:
            ids, pieces, sizes = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(tokenizer.encode_ordinary(text)) if text else 0
                for p in range(max(1, -(-n // capacity))):
                    ids.append(key), pieces.append(p), sizes.append(min(capacity, n - p * capacity))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(sizes, pa.int32())], names=["id", "piece", "size"])

    items = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tokens, "id long, piece int, size int")
    items = materialise(items, "pieces")
    counts = {r["size"]: r["n"] for r in items.where("size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    flows, _ = pack_histogram(counts, capacity, groups)
    columns = zip(*flows, strict=True) if flows else [[]] * 5
    flow = spark.createDataFrame(pa.table(dict(zip(("size", "lo", "hi", "base", "each"), (pa.array(x, pa.int64()) for x in columns), strict=True))))
    parts = spark.createDataFrame(pa.table({"size": pa.array(counts, pa.int32()), "parts": pa.array([-(-n // bucket_rows) for n in counts.values()], pa.int64())}))
    # a size of many items in hash buckets: each bucket is numbered by itself and begins where those before it end
    filled = items.where("size > 0").join(F.broadcast(parts), "size").withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.col("parts")))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = filled.where("parts > 1").groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n")).select("size", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    small = lambda table, rows: F.broadcast(table) if rows <= BROADCAST_ROWS else table
    place = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("id", "piece"))
    ranked = filled.withColumn("place", place).join(small(offsets, sum(counts.values()) // bucket_rows), ["size", "bucket"], "left").withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("place") - 1)
    put = ranked.join(small(flow, len(flows)), (ranked["size"] == flow["size"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    put = put.select("id", "piece", ranked["size"].alias("size"), (F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("long").alias("container"))
    rows = put.unionByName(items.where("size = 0").select("id", "piece", "size", F.lit(None).cast("long").alias("container")))
    start = F.col("piece").cast("long") * capacity
    return rows.select(F.col("id").alias(id_col), "piece", start.alias("token_start"), (start + F.col("size")).alias("token_end"), F.col("size").alias("n_tokens"), "container")

"""Mapping reads to a sequence graph that fits a task: chains of anchors, paths and banded alignment, on arrays."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.operators.sequences import kmer_codes, minimizer_places, topological_ranks

# Match, mismatch and gap scores of the banded alignment; anchors that a chain may look back over; the number of
# nodes up to which fewest hops are used between nodes (beyond, the difference of ranks); the weights of gaps and hops.
MATCH, MISMATCH, GAP, LOOK_BACK, HOP_NODES = 2, -4, -3, 256, 2000
SAME_GAP, OTHER_GAP, HOP = 0.5, 0.8, 0.2


class Graph:
    """Node sequences and edges as arrays: nodes are numbered as given, successors lie side by side in the edges' order."""

    def __init__(self, nodes: dict[str, str], edges: list[tuple[str, str]]):
        self.names, self.seqs = list(nodes), list(nodes.values())
        self.number = {name: i for i, name in enumerate(self.names)}
        known = [(self.number[a], self.number[b]) for a, b in edges if a in nodes and b in nodes]
        source = np.array([a for a, _ in known], np.int64)
        by = np.argsort(source, kind="stable")
        self.targets = np.array([b for _, b in known], np.int64)[by]
        self.first = np.searchsorted(source[by], np.arange(len(self.names) + 1))
        self.rank = np.full(len(self.names), -1, np.int64)
        try:
            ranks = topological_ranks(self.names, [(self.names[a], self.names[b]) for a, b in known])
            self.rank[[self.number[name] for name in ranks]] = list(ranks.values())
        except ValueError:
            pass  # a cycle: no node has a rank
        self._trees: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def tree(self, root: int) -> tuple[np.ndarray, np.ndarray]:
        """(hops, parent) of the breadth-first tree of `root`, level by level: hops -1 where there is no way. Of several parents
        the one reached first counts."""
        if root not in self._trees:
            hops, parent = np.full(len(self.names), -1, np.int32), np.full(len(self.names), -1, np.int64)
            front, level = np.array([root]), 0
            hops[root] = 0
            while len(front):
                level += 1
                n = self.first[front + 1] - self.first[front]
                at = np.repeat(self.first[front] - np.cumsum(n) + n, n) + np.arange(n.sum())
                found, came = self.targets[at], np.repeat(front, n)
                new = hops[found] < 0
                found, came = found[new], came[new]
                _, once = np.unique(found, return_index=True)
                front = found[np.sort(once)]
                hops[front], parent[front] = level, came[np.sort(once)]
            self._trees[root] = hops, parent
        return self._trees[root]

    def between(self, a: int, b: int) -> list[int]:
        """The nodes after `a` on the way to `b`, which is the last; none without a way."""
        hops, parent = self.tree(a)
        way = []
        while hops[b] > 0:
            way.append(b)
            b = int(parent[b])
        return way[::-1]

    def steps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hops from nodes `a` (rows) to nodes `b` (columns): fewest edges, else at least 1 by ranks, -1 where neither is known."""
        out = self.rank[b][None, :] - self.rank[a][:, None]
        ordered = (out >= 0) & (self.rank[a][:, None] >= 0)
        out = np.where(ordered, np.maximum(out, 1), -1)
        if len(self.names) <= HOP_NODES:
            roots, row = np.unique(a, return_inverse=True)
            hops = np.stack([self.tree(int(r))[0][b] for r in roots])[row] if len(roots) else np.empty(out.shape)
            out = np.where(hops >= 0, hops, out)
        return out


def link_scores(q: np.ndarray, node: np.ndarray, pos: np.ndarray, at: slice, before: slice, k: int, steps) -> np.ndarray:
    """What linking each anchor in `at` (rows) to each in `before` (columns) scores; minus infinity where the order forbids it."""
    dq = q[at][:, None] - q[before][None, :]
    dr = pos[at][:, None] - pos[before][None, :]
    same = node[at][:, None] == node[before][None, :]
    hops = steps(node[before], node[at]).T
    score = np.where(same, k - SAME_GAP * np.abs(dq - dr), k - OTHER_GAP * np.abs(dq - hops * k) - HOP * hops)
    allowed = (dq >= 0) & np.where(same, dr >= 0, hops >= 0)
    return np.where(allowed, score, -np.inf)


def chain(q: np.ndarray, node: np.ndarray, pos: np.ndarray, k: int, steps, block: int = 128) -> tuple[float, np.ndarray]:
    """The best chain of anchors that are given in order: its score and the places of its anchors.

    An anchor alone scores k; it is linked to the first of those up to LOOK_BACK places before it that raise its score most.
    Link scores come in matrices of `block` anchors against all they may look back on; `steps` gives the hops between nodes.
    """
    n = len(q)
    total, back = np.full(n, float(k)), np.full(n, -1, np.int64)
    for lo in range(0, n, block):
        hi, first = min(lo + block, n), max(0, lo - LOOK_BACK)
        links = link_scores(q, node, pos, slice(lo, hi), slice(first, hi), k, steps)
        for i in range(lo, hi):
            a = max(0, i - LOOK_BACK)
            if i > a:
                through = total[a:i] + links[i - lo, a - first : i - first]
                best = int(through.argmax())
                if through[best] > total[i]:
                    total[i], back[i] = through[best], a + best
    if not n:
        return 0.0, np.empty(0, np.int64)
    places = [int(total.argmax())]
    while back[places[-1]] >= 0:
        places.append(int(back[places[-1]]))
    return float(total[places[0]]), np.array(places[::-1])


def chain_path(nodes: np.ndarray, graph: Graph) -> list[int]:
    """The nodes of a chain, each way between two that differ filled in; without a way they stand side by side."""
    if not len(nodes):
        return []
    turns = np.flatnonzero(np.diff(nodes))
    path = [int(nodes[0])]
    for a, b in zip(nodes[turns].tolist(), nodes[turns + 1].tolist(), strict=True):
        path.extend(graph.between(a, b) or [b])
    return path


def banded_score(query: str, ref: str, band: int) -> tuple[int, int, int]:
    """(score, cells, pseudo edit distance) of a global alignment within a band around the diagonal.

    Rows are vectors: the gap in the query's direction is a running maximum. Where the ends lie farther apart than the band,
    the best score of the last row counts. An empty side gives 0, 0 and the other's length.
    """
    m, n = len(query), len(ref)
    if not m or not n:
        return 0, 0, max(m, n)
    low, r = -(10**12), np.frombuffer(ref.encode("latin-1", "replace"), np.uint8)
    prev = np.full(n + 1, low, np.int64)
    prev[: min(n, band) + 1] = GAP * np.arange(min(n, band) + 1)
    cells = 0
    for i, c in enumerate(query.encode("latin-1", "replace"), 1):
        lo, hi = max(1, i - band), min(n, i + band)
        cur = np.full(n + 1, low, np.int64)
        if lo == 1:
            cur[0] = prev[0] + GAP
        if hi >= lo:
            cells += hi - lo + 1
            best = np.maximum(prev[lo - 1 : hi] + np.where(r[lo - 1 : hi] == c, MATCH, MISMATCH), prev[lo : hi + 1] + GAP)
            if lo == 1:
                best[0] = max(best[0], cur[0] + GAP)
            at = np.arange(hi - lo + 1)
            cur[lo : hi + 1] = np.maximum.accumulate(best - GAP * at) + GAP * at
        prev = cur
    score = int(prev[n] if abs(m - n) <= band else prev.max())
    return score, cells, int(max(0, (2 * max(1, min(m, n)) - score) / 3))


class Mapper:
    """A graph with the minimizer index of its nodes: sorted codes, and node and place of each."""

    def __init__(self, graph: Graph, k: int, w: int, band: int, max_occ: int):
        self.graph, self.k, self.w, self.band, self.max_occ = graph, k, w, band, max_occ
        found = [minimizer_places(*kmer_codes(s, k), w) for s in graph.seqs]
        node = np.repeat(np.arange(len(found)), [len(at) for at, _ in found])
        code = np.concatenate([c for _, c in found]) if found else np.empty(0, np.uint64)
        by = np.argsort(code, kind="stable")
        self.code, self.node, self.place = code[by], node[by], (np.concatenate([a for a, _ in found]) if found else np.empty(0, np.int64))[by]

    def anchors(self, seq: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query place, node, node place) by query place, rank (nodes without one last) and node place; k-mers of more than
        `max_occ` places in the graph are left out."""
        at, code = minimizer_places(*kmer_codes(seq, self.k), self.w)
        first = np.searchsorted(self.code, code)
        n = np.searchsorted(self.code, code, "right") - first
        n[n > self.max_occ] = 0
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        q, node, pos = np.repeat(at, n), self.node[entry], self.place[entry]
        rank = self.graph.rank[node]
        by = np.lexsort((pos, np.where(rank < 0, np.iinfo(np.int64).max, rank), q))
        return q[by], node[by], pos[by]

    def record(self, raw: str | None) -> tuple:
        """(length, anchors, chained, chain_score, path, cells, score, distance); without a path the distance is the length."""
        seq = (raw or "").upper().replace("N", "A")
        q, node, pos = self.anchors(seq)
        score, used = chain(q, node, pos, self.k, self.graph.steps)
        path = chain_path(node[used], self.graph)
        text = "".join(self.graph.seqs[i] for i in path)
        if not text:
            return len(seq), len(q), 0, 0, [], 0, 0, len(seq)
        points, cells, distance = banded_score(seq, text, self.band)
        return len(seq), len(q), len(used), int(score), [self.graph.names[i] for i in path], cells, points, distance


RECORD = ["length", "anchors", "chained", "chain_score", "path", "cells", "score", "distance"]
RECORD_SCHEMA = "length long, anchors long, chained long, chain_score long, path array<string>, cells long, score long, distance long"


def align(reads: DataFrame, read: str, seq: str, nodes: dict[str, str], edges: list[tuple[str, str]], k: int, w: int, band: int, max_occ: int = 1000, max_nodes: int = 20_000) -> DataFrame:
    """Every read mapped to one graph: anchors, best chain, path, banded alignment. The graph is one subgraph of at most
    `max_nodes` nodes (checked) and is broadcast; reads are never grouped. A read without a path has its length as distance."""
    if len(nodes) > max_nodes:
        raise ValueError(f"{len(nodes)} nodes; one subgraph is bounded to {max_nodes}: see align_local")
    shared = reads.sparkSession.sparkContext.broadcast((nodes, edges))

    def run(parts):
        mapper = Mapper(Graph(*shared.value), k, w, band, max_occ)
        for pdf in parts:
            yield pd.DataFrame([(key, *mapper.record(raw)) for key, raw in zip(pdf[read], pdf[seq], strict=True)], columns=[read, *RECORD])

    return reads.select(read, seq).mapInPandas(run, f"{read} {dict(reads.dtypes)[read]}, {RECORD_SCHEMA}")


def align_local(reads: DataFrame, read: str, seq: str, near: DataFrame, nodes: DataFrame, node: str, node_seq: str, edges: DataFrame, k: int, w: int, band: int, max_occ: int = 1000) -> DataFrame:
    """Every read mapped to the subgraph of its own nodes in `near` (read, node), however large the graph is.

    Nodes and edges are joined to the reads' nodes, and one group is a read with its subgraph; each is bounded by what `near`
    gives a read. A read without nodes is left out, null sequences of nodes count as empty.
    """
    mine = near.select(read, F.col(node).alias("_node")).distinct()
    held = mine.join(nodes.select(F.col(node).alias("_node"), F.coalesce(node_seq, F.lit("")).alias("_seq")), "_node")
    out = edges.select(F.col("source").alias("_node"), "target").groupBy("_node").agg(F.sort_array(F.collect_set("target")).alias("_out"))
    rows = held.join(out, "_node", "left").join(reads.select(read, F.col(seq).alias("_read")), read)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_node")
        links = [(a, b) for a, n in zip(pdf["_node"], pdf["_out"], strict=True) if n is not None for b in n]
        mapper = Mapper(Graph(dict(zip(pdf["_node"], pdf["_seq"], strict=True)), links), k, w, band, max_occ)
        return pd.DataFrame([(pdf[read].iloc[0], *mapper.record(pdf["_read"].iloc[0]))], columns=[read, *RECORD])

    return rows.groupBy(read).applyInPandas(run, f"{read} {dict(reads.dtypes)[read]}, {RECORD_SCHEMA}")


def read_chains(anchors: DataFrame, read: str, query_pos: str, node: str, node_pos: str, rank: str, k: int) -> DataFrame:
    """(read, anchors, chained, score): the best chain of every read's distinct anchors, hops between nodes by their ranks.

    Rows are partitioned and sorted by read and streamed through in batches; only one read's anchors, which its length bounds,
    are carried from a batch to the next. Anchors with a null are left out, except for the rank: without one a node is only
    linked to itself.
    """
    rows = anchors.select(F.col(read).alias("r"), F.col(query_pos).cast("long").alias("q"), F.col(node).cast("string").alias("n"), F.col(node_pos).cast("long").alias("p"), F.coalesce(F.col(rank).cast("long"), F.lit(-1)).alias("k"))
    rows = rows.where("r IS NOT NULL AND q IS NOT NULL AND n IS NOT NULL AND p IS NOT NULL").repartition("r").distinct()
    kind = dict(rows.dtypes)["r"]

    def best(q, number, p, ranks):
        _, local = np.unique(number, return_inverse=True)
        of = np.empty(local.max() + 1, np.int64)
        of[local] = ranks

        def steps(a, b):
            d = of[b][None, :] - of[a][:, None]
            return np.where((d >= 0) & (of[a][:, None] >= 0), np.maximum(d, 1), -1)

        score, used = chain(q, local, p, k, steps)
        return len(used), score

    def scored(tbl: pa.Table) -> pa.RecordBatch:
        """One row for each read of a table of whole reads."""
        tbl = tbl.combine_chunks()
        number = tbl.column("n").chunk(0).dictionary_encode().indices.to_numpy()
        q, p, ranks = (tbl.column(c).to_numpy() for c in "qpk")
        code = tbl.column("r").chunk(0).dictionary_encode().indices.to_numpy()
        start = np.flatnonzero(np.r_[True, np.diff(code) != 0])
        ends = np.r_[start[1:], len(code)]
        found = [best(q[a:b], number[a:b], p[a:b], ranks[a:b]) for a, b in zip(start, ends, strict=True)]
        return pa.RecordBatch.from_arrays([tbl.column("r").chunk(0).take(pa.array(start)), pa.array(ends - start), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["r", "anchors", "chained", "score"])

    def run(batches):
        held = None
        for batch in batches:
            tbl = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if not tbl.num_rows:
                continue
            code = tbl.column("r").combine_chunks().dictionary_encode()
            code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
            cut = int(np.flatnonzero(np.r_[True, np.diff(code) != 0])[-1])
            if cut:
                yield scored(tbl.slice(0, cut))
            held = tbl.slice(cut)
        if held is not None and held.num_rows:
            yield scored(held)

    ordered = rows.sortWithinPartitions("r", "q", F.when(F.col("k") >= 0, F.col("k")).asc_nulls_last(), "p", "n")
    return ordered.mapInArrow(run, f"r {kind}, anchors long, chained long, score double").withColumnRenamed("r", read)

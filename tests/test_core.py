"""Operators of the core on small fixtures: brute force, properties and hand values."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixlake.functions import bits, peaks, scalars
from helixlake.operators import bandjoin, buckets, chunked, clustering, heavykeys, hypervectors, mapping, metrics, models, ordered, search, sequences, warehouse
from helixlake.plans import lineage


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_eager_join_equals_the_join(spark):
    rng = random.Random(1)
    left = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice("ab"), rng.randint(1, 9)) for _ in range(300)]
    right = [(rng.choice([1, 2, 4, None]), rng.randint(1, 5)) for _ in range(200)]
    a, b = spark.createDataFrame(left, "k int, g string, x long"), spark.createDataFrame(right, "k int, y long")
    got = rows(heavykeys.eager_join_sums(a, b, ["k"], ["g"], {"sx": F.col("x")}, {"sy": F.col("y")}))
    want = rows(a.join(b, "k").groupBy("g").agg(F.count(F.lit(1)), F.sum("x"), F.sum("y")))
    assert got == want
    outer = heavykeys.eager_join_sums(a, b.limit(0), ["k"], ["g"], how="left").collect()
    assert sum(r["n"] for r in outer) == 300
    assert heavykeys.eager_join_sums(a.limit(0), b, ["k"], ["g"]).count() == 0


def test_key_counts(spark):
    data = [(1, "aaaaaaaaaaaaaac", ">s1"), (1, "aaaaaaaaaaaaaac", ">s1"), (2, " GTTTTTTTTTTTTTT", "s 1"), (3, "NNNNNNNNNNNNNNN", "*"), (4, None, None), (5, "", ""), (None, "AAAAAAAAAAAAAAC", "s1")]
    df = spark.createDataFrame([(*r, 9) for r in data], "hit_id long, kmer string, node_id string, key_value int")
    forms = {"kmer": heavykeys.canonical_kmer, "node_id": heavykeys.canonical_node}
    c = heavykeys.key_counts(df, "hit_id", forms)
    assert rows(c) == [("kmer", "AAAAAAAAAAAAAAC", 2), ("node_id", "s1", 2)]
    assert heavykeys.heavy_keys(c, 5, 0.5).count() == 0 and heavykeys.heavy_keys(c, 0).count() == 0
    assert heavykeys.key_counts(df.limit(0), "hit_id", forms).count() == 0


def test_band_join_equals_brute_force(spark):
    rng = random.Random(2)
    left = [(i, rng.choice([1, 2, None]), rng.choice([None, rng.uniform(-50, 50)])) for i in range(80)]
    right = [(i, rng.choice([1, 2, 3]), rng.uniform(-50, 50)) for i in range(90)]
    a, b = spark.createDataFrame(left, "i long, z int, v double"), spark.createDataFrame(right, "j long, z int, w double")
    got = {(r["i"], r["j"]) for r in bandjoin.band_join(a, b, "v", "w", F.lit(3.0), 5.0, ["z"]).collect()}
    assert got == {(i, j) for i, z, v in left for j, y, w in right if z == y and v is not None and v - 3 <= w <= v + 3}
    every = bandjoin.open_band_join(a, b.withColumnRenamed("z", "y"), "v", "w", "z", "y", F.lit(3.0), 5.0)
    assert {(r["i"], r["j"]) for r in every.collect()} == {(i, j) for i, z, v in left for j, y, w in right if (z == y or z is None) and v is not None and abs(v - w) <= 3}
    assert bandjoin.band_join(a, b.limit(0), "v", "w", F.lit(3.0), 5.0, ["z"], "left").count() == 80


def test_buckets(spark):
    df = spark.createDataFrame([(501.0, 2), (502.0, 2), (501.0, 3), (None, None), (-1.5, 1)], "m double, z int")
    sizes = buckets.bucket_sizes(df, F.col("z"), F.col("m"), 5.0)
    assert rows(sizes) == [(0, 0, 1), (1, -1, 1), (2, 100, 2), (3, 100, 1)]
    p = buckets.pair_survival(spark.createDataFrame([(3,), (1,)], "n long")).first()
    assert (p["all_pairs"], p["candidate_pairs"], p["reduction_percent"]) == (6, 3, 50.0)
    assert buckets.pair_survival(sizes.limit(0)).first()["survival_ratio"] == 0.0
    assert [r[0] for r in df.limit(5).select(bandjoin.bucket_key(F.col("m"), 1.0, "truncate")).collect()][-1] == -1


def test_q_values_equal_the_sequential_rule(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("ab"), round(rng.random(), 2), rng.random() < 0.3) for i in range(300)]
    df = spark.createDataFrame(data, "id long, g string, score double, decoy boolean")
    for by in ([], ["g"]):
        got = {r["id"]: r["q"] for r in search.q_values(df, "score", "decoy", by).collect()}
        for group in [data] if not by else [[r for r in data if r[1] == g] for g in "ab"]:
            fdr = {}
            for s in {r[2] for r in group}:
                above = [r[3] for r in group if r[2] >= s]
                fdr[s] = sum(above) / max(1, len(above) - sum(above))
            for i, _, s, _ in group:
                assert got[i] == pytest.approx(min(f for t, f in fdr.items() if t <= s))
    assert search.q_values(df.limit(0), "score", "decoy").count() == 0


def test_mass_groups_equal_the_greedy_rule(spark):
    rng = random.Random(4)
    data = [(i, rng.random(), rng.choice([0.0, 0.05, 1.0, 16.0]) + rng.uniform(-0.1, 0.1)) for i in range(200)]
    got = {r["id"]: r["mass_group"] for r in search.mass_groups(spark.createDataFrame(data, "id long, s double, m double"), "id", "s", "m", 0.1, 5).collect()}
    left, groups = sorted(data, key=lambda r: (-r[1], r[0])), []
    while left:
        near = [r for r in left if abs(r[2] - left[0][2]) <= 0.1]
        groups.append({r[0] for r in near} if len(near) >= 5 else None)
        left = [r for r in left if r not in near]
    mine = {}
    for i, g in got.items():
        mine.setdefault(g, set()).add(i)
    rare = mine.pop("-1", set())
    assert sorted(map(sorted, mine.values())) == sorted(sorted(g) for g in groups if g)
    assert len(rare) + sum(map(len, mine.values())) == 200


@pytest.mark.parametrize(("finish", "ppm"), [(0, None), (30, None), (0, "o"), (10**6, "o")])
def test_dense_mass_groups_in_rounds(spark, finish, ppm):
    """One stretch without a gap, two thirds of it within one tolerance."""
    rng = random.Random(14)
    data = [(i, round(rng.random(), 1), rng.uniform(0, 3) if i % 3 == 0 else rng.uniform(1.0, 1.1), rng.uniform(300, 900)) for i in range(240)]
    df = spark.createDataFrame(data, "id long, s double, m double, o double")
    got = {r["id"]: r["mass_group"] for r in search.mass_groups(df, "id", "s", "m", 200.0 if ppm else 0.1, 4, ppm_of=ppm, finish_rows=finish).collect()}
    left, want = sorted(data, key=lambda r: (-r[1], r[0])), {}
    while left:
        c = left[0]
        near = [r for r in left if r == c or (abs(r[2] - c[2]) / r[3] * 1e6 <= 200 if ppm else abs(r[2] - c[2]) <= 0.1)]
        want |= {r[0]: str(c[0]) if len(near) >= 4 else "-1" for r in near}
        left = [r for r in left if r not in near]
    assert got == want
    assert search.mass_groups(df.limit(0), "id", "s", "m", 0.1, 4).count() == 0


def test_standard_stage_and_grid(spark):
    rng = np.random.default_rng(15)
    base = rng.integers(0, 2**40, (12, 4)).tolist()
    lib = spark.createDataFrame([(i, 2, 500.0 + (i % 3), base[i], i % 4 == 3) for i in range(12)], "item long, charge int, precursor_mz double, w array<long>, is_decoy boolean")
    q = spark.createDataFrame([(100 + i, 2, 500.0 + (i % 3), base[i]) for i in range(12)] + [(200, 3, 500.0, base[0])], "query long, charge int, query_mz double, qw array<long>")
    got = search.standard_stage(q, lib, F.lit(0.5), 1.0, 160).collect()
    assert {r["query"]: r["item"] for r in got} == {100 + i: i for i in range(12)} and all(r["similarity"] == 160 for r in got)

    def encode(df, setting):
        if setting["flip"] > 1:
            raise ValueError("no such codebook")
        return df if "w" in df.columns else df.withColumnRenamed("qw", "w")

    grid = search.calibration_grid(q, lib, [{"dim": 160, "flip": 1}, {"dim": 160, "flip": 2}], ["score", "zscore"], encode, 0.5)
    assert [(r["mode"], r["identified"], r["error"]) for r in grid.collect()] == [("score", 9, None), ("zscore", 9, None), (None, None, "no such codebook")]


def test_filtered_similarity_spares_only_what_cannot_reach(spark):
    rng = np.random.default_rng(16)
    data = [(i, rng.integers(0, 2**56, 5).tolist(), rng.integers(0, 2**56, 5).tolist()) for i in range(60)]
    df = spark.createDataFrame(data, "i long, a array<long>, b array<long>")
    full = {i: 280 - sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) for i, a, b in data}
    got = hypervectors.filtered_similarity(df, F.col("a"), F.col("b"), 2, 56, 280, F.lit(150))
    kept = {r["i"]: r["similarity"] for r in got.collect()}
    assert all(full[i] == s for i, s in kept.items()) and {i for i, s in full.items() if s >= 150} <= set(kept)


def test_calibration_of_a_single_candidate(spark):
    r = search.calibrated(spark.createDataFrame([(1, 5, 90.0), (2, 3, 80.0), (2, 1, 80.0), (2, 9, 60.0)], "q long, i long, s double"), "q", "i", "s", 100).orderBy("q").collect()
    assert (r[0]["margin"], r[0]["runner_up"], r[0]["sd"]) == (0.0, 90.0, 1e-6)
    assert (r[1]["i"], r[1]["runner_up"], r[1]["normalized"]) == (1, 80.0, pytest.approx(0.6))


def test_cluster_metrics_equal_pair_counting(spark):
    rng = random.Random(5)
    truth, pred = [rng.randint(0, 4) for _ in range(50)], [rng.randint(0, 6) for _ in range(50)]
    m = metrics.cluster_metrics(metrics.contingency(spark.createDataFrame(list(zip(truth, pred, strict=True)), "t int, p int"), "t", "p")).first()
    pairs = list(itertools.combinations(range(50), 2))
    both = sum(truth[i] == truth[j] and pred[i] == pred[j] for i, j in pairs)
    assert m["precision"] == pytest.approx(both / sum(pred[i] == pred[j] for i, j in pairs))
    assert m["recall"] == pytest.approx(both / sum(truth[i] == truth[j] for i, j in pairs))
    b = np.mean([sum(t == truth[i] and p == pred[i] for t, p in zip(truth, pred, strict=True)) / pred.count(pred[i]) for i in range(50)])
    assert m["bcubed_precision"] == pytest.approx(b)
    perfect = metrics.cluster_metrics(metrics.contingency(spark.createDataFrame([(i % 3, i % 3 + 7) for i in range(30)], "t int, p int"), "t", "p")).first()
    assert all(perfect[c] == pytest.approx(1.0) for c in ("ari", "nmi", "homogeneity", "completeness", "bcubed_f1", "exact_ratio"))


def test_assignment_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    for n, m in ((4, 4), (3, 5), (5, 3)):
        g = rng.integers(0, 20, (n, m)).astype(float)
        k = min(n, m)
        want = max(sum(g[r, c] for r, c in zip(rs, cs, strict=True)) for rs in itertools.permutations(range(n), k) for cs in itertools.combinations(range(m), k))
        assert metrics.best_assignment(g) == want
    t = spark.createDataFrame([(0, 1, 5), (0, 2, 1), (1, 1, 2), (1, 2, 7)], "truth int, predicted int, n long")
    assert metrics.assignment_accuracy(t) == 12 / 15


def test_linkage_diameter_and_maximality(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 2, (40, 64))
    d = (x[:, None] != x[None]).sum(axis=2)
    label = clustering.complete_linkage(d, 28)
    for a in set(label):
        assert d[np.ix_(label == a, label == a)].max() <= 28
        for b in set(label) - {a}:
            assert d[np.ix_(label == a, label == b)].max() > 28
    assert clustering.complete_linkage(np.array([[0, 900], [900, 0]]), 0.455 * 2048).tolist() == [0, 0]
    with pytest.raises(ValueError):
        df = spark.createDataFrame([(i, 1, bytes(8)) for i in range(5)], "id long, k int, hv binary")
        clustering.bucket_clusters(df, "id", ["k"], "hv", 8, max_bucket=4)
    v = [np.packbits(np.where(rng.random(64) < 0.1, 1 - base, base).astype(np.uint8)).tobytes() for base in rng.integers(0, 2, (12, 64)) for _ in range(5)]
    df = spark.createDataFrame([(i, 1, h) for i, h in enumerate(v)], "id long, k int, hv binary")
    whole, split = ({frozenset(r["ids"]) for r in clustering.bucket_clusters(df, "id", ["k"], "hv", 8, 0.25, max_bucket=n).groupBy("cluster").agg(F.collect_list("id").alias("ids")).collect()} for n in (100, 30))
    assert whole == split and len(whole) > 12


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    nodes = [(i,) for i in [*range(81), *range(100, 141), 500]]
    got = dict(rows(clustering.components(spark.createDataFrame(nodes, "n long"), spark.createDataFrame(edges, "a long, b long"), "n", "a", "b")))
    root = {n: n for (n,) in nodes}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_exact_top_k(spark):
    df = spark.createDataFrame([(20, b"\x00" * 8), (30, b"\xff" * 8), (10, b"\x00" * 8), (40, None), (50, b"ab")], "id long, hv binary")
    q = spark.createDataFrame([(1, b"\x00" * 8)], "id long, hv binary")
    got = [tuple(r) for r in hypervectors.top_k(df, q, "id", "hv", 5, 8).orderBy("place").collect()]
    assert got == [(1, 10, 64, 1), (1, 20, 64, 2), (1, 30, 0, 3)]
    assert hypervectors.top_k(df.limit(0), q, "id", "hv", 5, 8).count() == 0


def test_top_k_holds_no_square_of_all_queries():
    """Lists equal the definition, with equal vectors and short batches, and what is held doesn't follow the number of queries."""
    rng = np.random.default_rng(3)
    vec, refs = rng.integers(0, 256, (3000, 16), np.uint8), rng.integers(0, 256, (6000, 16), np.uint8)
    refs[2000:5000] = refs[7]
    vec[:50] = refs[7]
    items = rng.permutation(6000)
    batches = [pa.RecordBatch.from_arrays([pa.array(items[a:b]), pa.array([r.tobytes() for r in refs[a:b]], pa.binary())], names=["item", "hv"]) for a, b in ((0, 3), (3, 3), (3, 4500), (4500, 6000))]
    tracemalloc.start()
    got, far = hypervectors.nearest_rows(vec.view(np.uint64), batches, 10, 16)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3000 * 4096 * 8 / 4
    for q in [*range(60), *range(60, 3000, 97)]:
        d = np.bitwise_count(vec[q] ^ refs).sum(axis=1)
        by = np.lexsort((items, d))[:10]
        assert got[q].tolist() == items[by].tolist() and far[q].tolist() == d[by].tolist()
    assert hypervectors.nearest_rows(vec.view(np.uint64), batches[:2], 10**9, 16)[0].shape == (3000, 3)


def test_encoders(spark):
    e = hypervectors.Encoder(dim=256, bins=50, levels=8)
    book = np.unpackbits(hypervectors.position_codebook(20, 256, 1, "locality", 8), axis=1)
    assert {(a != b).sum() for a, b in zip(book, book[1:], strict=False)} == {8}
    walk = hypervectors.level_codebook(8, 256, 3, "walk")
    assert {(a != b).sum() for a, b in zip(walk, walk[1:], strict=False)} == {32}
    half = hypervectors.level_codebook(5, 256, 3)
    assert [(half[0] != r).sum() for r in half] == [0, 32, 64, 96, 128]
    position, level = hypervectors.gaussian_codebooks(200, 8, 1024, 5)
    share = np.mean([(a != b).mean() for a, b in zip(position, position[1:], strict=False)])
    assert share == pytest.approx(1 - np.exp(-0.5), abs=0.01) and {(a != b).sum() for a, b in zip(level, level[1:], strict=False)} == {64}
    df = spark.createDataFrame([(1, [3.2, 7.9], [1.0, 9.0]), (2, [], []), (3, None, None)], "id long, mz array<double>, i array<double>")
    got = dict(rows(hypervectors.encode(df, "id", "mz", "i", e)))
    assert len(got[1]) == 32 and got[2] == got[3] == bytes(32)
    p, lv = e.codebooks()
    want = p[3] * lv[1] * 2 + p[7] * lv[7] * 8
    assert got[1] == np.packbits(want >= 0, bitorder="little").tobytes()
    assert hypervectors.Encoder(style="aligned", dim=64, bins=5).encode(np.array([]), np.array([]), None, None) == bytes(8)
    with pytest.raises(ValueError):
        hypervectors.Encoder(dim=10).codebooks()


def test_coarse_filter_is_monotone_and_lossless(spark):
    data = [(i, p, p + e) for i, (p, e) in enumerate(itertools.product(range(0, 65, 8), range(0, 65, 8)))]
    df = spark.createDataFrame(data, "id long, part int, whole int")
    sizes = [hypervectors.coarse_filter(df, "part", 64, 128, F.lit(t)).count() for t in (0, 60, 90, 128)]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] == len(data)
    assert hypervectors.coarse_filter(df, "part", 64, 128, F.lit(90)).where("whole >= 90").count() == df.where("whole >= 90").count()


def test_minimizers_equal_brute_force(spark):
    rng, turn = random.Random(9), str.maketrans("ACGT", "TGCA")
    seqs = [(str(i), "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=n))) for i, n in enumerate([0, 4, 5, 8, 60, 300])] + [("none", None)]

    def want(s, k=5, w=4):
        words = [(min(x, x[::-1].translate(turn)), i) for i in range(len(s) - k + 1) if not set(x := s[i : i + k]) - set("ACGT")]
        return {min(words)} if words and len(words) <= w else {min(words[i : i + w]) for i in range(len(words) - w + 1)}

    got = {}
    for r in sequences.minimizers(spark.createDataFrame(seqs, "id string, s string"), "id", "s", 5, 4).collect():
        got.setdefault(r["id"], set()).add((r["kmer"], r["pos"]))
    assert got == {i: want(s) for i, s in seqs if s and want(s)}


def test_graph_orders(spark):
    nodes = spark.createDataFrame([("a", ["b", "c"]), ("b", ["d"]), ("c", ["d", "x", "c2"]), ("d", None), ("p", ["q"]), ("q", ["p"]), ("c2", [])], "n string, e array<string>")
    edges = sequences.clean_edges(nodes, "n", "e")
    assert edges.count() == 7
    assert dict(rows(sequences.topological_levels(nodes, edges, "n"))) == {"a": 0, "b": 1, "c": 1, "c2": 2, "d": 2, "p": None, "q": None}
    rank = {r["node"]: r["rank"] for r in sequences.topological_order(nodes, edges, "n").collect()}
    assert rank["a"] < rank["b"] < rank["d"] and rank["p"] is None
    with pytest.raises(ValueError):
        sequences.topological_ranks(["p", "q"], [("p", "q"), ("q", "p")])
    assert {(r["node"], r["hops"]) for r in sequences.hops(edges, nodes.where("n = 'a'"), "n", 5).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("c2", 2)}


def test_levels_beyond_max_rounds_are_no_cycle(spark):
    nodes, edges = spark.createDataFrame([("a",), ("b",), ("c",)], "n string"), spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    with pytest.raises(ValueError):
        sequences.topological_levels(nodes, edges, "n", max_rounds=2)
    assert dict(sequences.topological_levels(nodes, edges, "n", max_rounds=3).collect()) == {"a": 0, "b": 1, "c": 2}


def chain_by_definition(found, k, hops):
    """Score and places of the best chain of (query place, node, node place), one pair at a time."""
    score, back = [], []
    for i, (q, n, p) in enumerate(found):
        options = [(float(k), -1)]
        for j in range(max(0, i - 256), i):
            q0, n0, p0 = found[j]
            if q < q0 or (n == n0 and p < p0) or (n != n0 and hops(n0, n) is None):
                continue
            gain = k - 0.5 * abs((q - q0) - (p - p0)) if n == n0 else k - 0.8 * abs((q - q0) - hops(n0, n) * k) - 0.2 * hops(n0, n)
            options.append((score[j] + gain, j))
        top = max(o[0] for o in options)
        score.append(top)
        back.append(next(j for s, j in options if s == top))
    at = score.index(max(score))
    places = [at]
    while back[places[-1]] >= 0:
        places.append(back[places[-1]])
    return score[at], places[::-1]


def test_chains_equal_the_definition():
    rng = random.Random(10)
    for n, names in ((1, 3), (40, 4), (700, 9)):
        found = sorted((rng.randrange(3 * n), rng.randrange(names), rng.randrange(60)) for _ in range(n))
        hops = lambda a, b: b - a if b > a else None
        steps = lambda a, b: np.where(b[None, :] > a[:, None], b[None, :] - a[:, None], -1)
        q, node, pos = (np.array(x) for x in zip(*found, strict=True))
        score, places = mapping.chain(q, node, pos, 11, steps)
        want = chain_by_definition(found, 11, hops)
        assert score == pytest.approx(want[0]) and places.tolist() == want[1]
    assert mapping.chain(np.array([], int), np.array([], int), np.array([], int), 5, None)[0] == 0.0


def test_ways_in_a_graph():
    g = mapping.Graph({"a": "A", "b": "C", "c": "G", "d": "T", "e": ""}, [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "zz")])
    assert [g.names[i] for i in g.between(0, 3)] == ["c", "d"] and g.between(3, 0) == [] and g.between(1, 1) == []
    assert g.rank.tolist() == [0, 3, 2, 4, 1]
    assert g.steps(np.array([0, 3]), np.array([3, 0, 4])).tolist() == [[2, 0, 1], [0, -1, -1]]
    loop = mapping.Graph({"a": "A", "b": "C"}, [("a", "b"), ("b", "a")])
    assert loop.rank.tolist() == [-1, -1] and loop.between(1, 0) == [0]


def banded_by_definition(x, y, band):
    best = {(0, 0): 0}
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            if (i, j) != (0, 0) and abs(i - j) <= band:
                steps = [(i - 1, j - 1, 2 if i and j and x[i - 1] == y[j - 1] else -4), (i - 1, j, -3), (i, j - 1, -3)]
                best[i, j] = max((best[a, b] + s for a, b, s in steps if (a, b) in best), default=-(10**9))
    return best[len(x), len(y)]


def test_banded_scores_equal_the_definition():
    rng = random.Random(11)
    for _ in range(30):
        x, y = ("".join(rng.choices("ACGT", k=rng.randint(1, 20))) for _ in "xy")
        band = max(abs(len(x) - len(y)), rng.randint(1, 20))
        score, cells, distance = mapping.banded_score(x, y, band)
        assert score == banded_by_definition(x, y, band) and distance == int(max(0, (2 * min(len(x), len(y)) - score) / 3))
        assert cells == sum(abs(i - j) <= band for i in range(1, len(x) + 1) for j in range(1, len(y) + 1))


def test_alignment(spark):
    assert mapping.banded_score("ACGT", "ACGT", 8) == (8, 16, 0)
    assert mapping.banded_score("", "ACG", 8) == (0, 0, 3)
    assert mapping.banded_score("ACGT", "AGT", 8)[0] == 3
    # a diamond: one way in, two branches, one way out
    rng = random.Random(12)
    nodes = {n: "".join(rng.choices("ACGT", k=60)) for n in ("in", "left", "right", "out")}
    edges = [("in", "left"), ("in", "right"), ("left", "out"), ("right", "out")]
    left, right = nodes["in"] + nodes["left"] + nodes["out"], nodes["in"] + nodes["right"] + nodes["out"]
    changed = right[:70] + ("A" if right[70] != "A" else "C") + right[71:]
    reads = [("r1", left), ("r2", right.lower()), ("r3", changed), ("r4", "CCCCC"), ("r5", None), ("r6", nodes["in"] + nodes["out"])]
    df = spark.createDataFrame(reads, "read string, seq string")
    got = {r["read"]: r for r in mapping.align(df, "read", "seq", nodes, edges, 11, 5, 64).collect()}
    assert got["r1"]["path"] == ["in", "left", "out"] and got["r2"]["path"] == ["in", "right", "out"] == got["r3"]["path"]
    assert [got[r]["distance"] for r in ("r1", "r2", "r3", "r4", "r5")] == [0, 0, 2, 5, 0] and got["r1"]["score"] == 2 * len(left) and got["r5"]["length"] == 0
    assert got["r6"]["path"][0] == "in" and got["r6"]["path"][-1] == "out" and len(got["r6"]["path"]) == 3
    near = df.crossJoin(spark.createDataFrame([(n,) for n in nodes], "n string")).select("read", "n")
    local = mapping.align_local(df, "read", "seq", near, spark.createDataFrame(list(nodes.items()), "n string, s string"), "n", "s", spark.createDataFrame(edges, "source string, target string"), 11, 5, 64)
    keep = ("read", "length", "score", "distance")
    assert sorted(tuple(r[c] for c in keep) for r in local.collect() if r["read"] != "r6") == sorted(tuple(r[c] for c in keep) for r in got.values() if r["read"] != "r6")
    with pytest.raises(ValueError):
        mapping.align(df, "read", "seq", nodes, edges, 11, 5, 64, max_nodes=3)
    assert sequences.minimizer_parameters(4) == (3, 6) and sequences.minimizer_parameters(1000) == (15, 16)


def test_read_chains(spark):
    rows_ = [("r", 0, "s1", 5, 1), ("r", 0, "s1", 5, 1), ("r", 15, "s2", 0, 2), ("r", 30, "x", 0, None), ("r", None, "s1", 0, 1), (None, 0, "s1", 0, 1), ("t", 3, "s9", 9, 9)]
    got = {r["r"]: (r["anchors"], r["chained"], r["score"]) for r in mapping.read_chains(spark.createDataFrame(rows_, "r string, q int, n string, p int, k long"), "r", "q", "n", "p", "k", 15).collect()}
    assert got == {"r": (3, 2, pytest.approx(29.8)), "t": (1, 1, 15.0)}


def test_slices(spark):
    df = spark.createDataFrame([("a", "ABCDEFGHIJ")], "n string, s string")
    assert rows(sequences.slices(df, "n", "s", [0, 6], 4)) == [("a", 0, 4, "ABCD"), ("a", 6, 10, "GHIJ")]
    with pytest.raises(Exception, match="too short"):
        sequences.slices(df, "n", "s", [7], 4).collect()
    assert df.select(sequences.packed_bytes(F.lit(1000), F.lit(150), F.lit(10_000))).first()[0] == 1000 * 19 * 4 + (10_000 // 32 + 1) * 4 + 4 + (10_000 // 8 + 1) * 4 + 1000 * 12


def test_running_totals_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(200)], "i long, v long")
    want = [(i, sum(j % 7 for j in range(i))) for i in range(200)]
    for n in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert rows(ordered.running_total(df, [F.col("i")], F.col("v"), "b").select("i", "b")) == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert ordered.until_total(df, [F.col("i")], "v", 10).count() == 5
    assert ordered.until_total(df.limit(0), [F.col("i")], "v", 10).count() == 0


def test_choices_and_sets(spark):
    s = spark.createDataFrame([(1, 99.5, 10.0), (2, 99.0, 30.0), (3, 50.0, 90.0)], "t int, recall double, reduction double")
    assert ordered.best_setting(s, "recall", "reduction", 99).first()["t"] == 2 and ordered.best_setting(s, "recall", "reduction", 100).first()["t"] == 1
    g = spark.createDataFrame([("a", i) for i in range(9)] + [("b", i) for i in range(4)] + [("c", 1)], "g string, i int")
    kept = ordered.capped_groups(g, "g", [F.col("i")], 5, 6).groupBy("g").count()
    assert rows(kept) == [("a", 5), ("c", 1)]
    sizes = {f"g{i}": n for i, n in enumerate([9, 9, 7, 5, 5, 4, 3, 3, 2, 1, 1, 1])}
    many = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)] + [(None, 1), (None, 2)], "g string, i int")
    for per, cap in ((5, 12), (5, 23), (4, 9), (2, 5), (9, 10**6)):
        left, want = cap, []
        for k, n in sorted([*sizes.items(), (None, 2)], key=lambda x: (-x[1], x[0] or "")):
            if min(n, per) <= left:
                want.append((k, min(n, per)))
                left -= min(n, per)
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in ordered.capped_groups(many, "g", [F.col("i")], per, cap).groupBy("g").count().collect())
    a = spark.createDataFrame([("ACGT",), ("A",)], "s string")
    x, y = (spark.createDataFrame(v, "i int, s string") for v in ([(1, "A"), (2, "CG"), (3, None)], [(2, "A"), (1, "CG"), (3, None)]))
    assert [ordered.equivalent_inputs(x, o, "s", by).first()["equivalent"] for o, by in ((y, None), (y, "i"), (x, "i"))] == [True, False, True]
    assert ordered.equivalent_inputs(a, a.orderBy("s"), "s").first()["equivalent"]
    assert not ordered.equivalent_inputs(a, spark.createDataFrame([("ACGA",), ("A",)], "s string"), "s").first()["equivalent"]


def test_intervals(spark):
    iv = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 3, 4), ("a", 10, 12), ("a", 20, 15), ("b", None, 3)], "g string, s long, e long")
    assert rows(warehouse.union_length(iv, ["g"], "s", "e")) == [("a", 9, 3)]
    assert rows(warehouse.union_length(warehouse.premerge(iv, ["g"], "s", "e", 4.0), ["g"], "s", "e")) == [("a", 9, 3)]


def test_scalars(spark):
    df = spark.createDataFrame([("3+",), ("3-",), ("2+ and 3+",), ("none",), (None,)], "c string")
    assert [r[0] for r in df.select(scalars.first_charge(F.col("c"))).collect()] == [3, 3, 2, None, None]
    c = spark.createDataFrame([("10M2I3D5S4=1X2N",), ("*",), (None,)], "c string").select(scalars.alignment_span(F.col("c")), scalars.reference_span(F.col("c"))).collect()
    assert [tuple(r) for r in c] == [(20, 20), (0, 0), (None, None)]
    k = spark.createDataFrame([("run10.b",), ("Run2.a",)], "s string").orderBy(scalars.natural_key(F.col("s"))).collect()
    assert [r[0] for r in k] == ["Run2.a", "run10.b"]
    assert spark.range(1).select(scalars.percent(F.lit(1), F.lit(0))).first()[0] is None


def test_keys_and_display_forms(spark):
    df = spark.createDataFrame([(2, 12.345, 500.1), (None, 1.0, 2.0), (2, None, 2.0), (2, 1.0, None)], "z int, t double, m double")
    assert [r[0] for r in df.select(scalars.rounded_key(F.col("z"), F.col("t"), F.col("m"))).collect()] == ["2|1234|500100", "0|100|2000", None, None]
    s = spark.createDataFrame([(0.5,), (59.0,), (90.0,), (7200.0,), (200_000.0,)], "s double")
    assert [r[0] for r in s.select(scalars.humanised_seconds(F.col("s"))).collect()] == ["0.50 s", "59.00 s", "1.50 min", "2.00 h", "2.31 days"]
    assert s.select(scalars.humanised_bytes(F.lit(1234567))).first()[0] == "1,234,567"


def test_digests_of_groups_of_any_size(spark):
    import hashlib

    h = lambda v: hashlib.sha256(v.encode()).hexdigest()
    data = [("a", i, f"v{i}") for i in range(10)] + [("b", 1, None), (None, 2, "x"), (None, 1, "y")]
    df = spark.createDataFrame(data, "g string, o int, v string").repartition(3)
    flat = lambda values: h("\n".join(values))
    got = {r["g"]: r["digest"] for r in scalars.stream_digest(df, ["g"], "o", "v").collect()}
    assert got == {"a": flat(h(f"v{i}") for i in range(10)), "b": flat([h("")]), None: flat([h("y"), h("x")])}
    blocks = [flat(h(f"v{i}") for i in range(a, min(a + 4, 10))) for a in (0, 4, 8)]
    assert {r["g"]: r["digest"] for r in scalars.stream_digest(df, ["g"], "o", "v", block=4).collect()}["a"] == flat(blocks)


def test_numbered_clusters(spark):
    df = spark.createDataFrame([(c,) for c in "dbacabd"], "c string")
    assert {(r["c"], r["id"]) for r in clustering.global_ids(df, "c", "p", "id").collect()} == {("a", "p:0"), ("b", "p:1"), ("c", "p:2"), ("d", "p:3")}


def test_chunks_go_on_after_a_failure(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "id long, v long")
    state = {"fail": True}

    def run(part):
        if state["fail"] and part.where("id = 7").count():
            raise ValueError("broken part")
        return part.select("id")

    first = run and chunked.run_chunks(df, "id", 4, run, f"file://{tmp_path}/out").collect()
    assert sorted(r["status"] for r in first) == ["failed", "ok", "ok", "ok"] and [r["error"] for r in first if r["error"]] == ["broken part"]
    state["fail"] = False
    again = chunked.run_chunks(df, "id", 4, run, f"file://{tmp_path}/out").collect()
    assert sorted(r["status"] for r in again) == ["done", "done", "done", "ok"]
    assert spark.read.parquet(f"file://{tmp_path}/out").select("id").distinct().count() == 50


def test_shared_folder_and_intermediates(spark, monkeypatch):
    import os

    with lineage.intermediates(spark):
        df = lineage.materialise(spark.range(3), "test")
        path = next(reversed(lineage._LIVE))
        assert df.count() == 3 and os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})  # noqa: PIE

        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Session())


def test_bits(spark):
    v = spark.createDataFrame([([1.0, -1.0, 0.0, 2.0] * 16,)], "v array<double>").withColumn("b", bits.sign_bits(F.col("v")))
    r = v.select(bits.pack_bits(F.slice("b", 1, 4), 4), bits.pack_words(F.col("b"), 64), bits.sign_bits(F.col("v"), 0)[2]).first()
    assert r[0] == 0b1101 and r[1] == [0xBBBBBBBB] * 2 and r[2] == 0


def test_peaks(spark):
    df = spark.createDataFrame([(1, [100.0, 200.0, 300.0], [1.0, 5.0, 5.0]), (2, [], []), (3, None, None)], "id long, m array<double>, i array<double>").withColumn("p", peaks.peak_list(F.col("m"), F.col("i")))
    top = df.select(F.transform(peaks.top_intense(F.col("p"), 2), lambda x: x["mz"])).collect()
    assert [r[0] for r in top] == [[200.0, 300.0], [], None]
    assert [r[0] for r in df.select(peaks.is_valid(F.col("p"), 2, 100.0)).collect()] == [True, False, False]
    assert peaks.dimensions(101, 1500, 0.05)[0] == 27981 and peaks.dimensions(101, 1500, 0.04)[0] == 34976


def test_models(spark):
    one = spark.range(1).select(*(c.alias(k) for k, c in models.encoding(F.lit(33)).items())).first()
    assert one["batches"] == 2 and one["seconds"] == pytest.approx(4e-7) and one["energy_mj"] == pytest.approx(33 * 50e-9)
    assert spark.range(1).select(models.encoding(F.lit(0))["seconds"]).first()[0] == 0.0
    assert spark.range(1).select(models.bucket(F.lit(1))["seconds"], models.bucket(F.lit(2))["seconds"]).first()[:2] == (0.0, pytest.approx(2 * 87e-9))
    f = spark.range(1).select(models.coarse_filter(F.lit(42828), preset="document")["seconds"]).first()[0]
    assert f == pytest.approx(1.48817e-3, rel=1e-4)
    t = models.total_latency(spark.createDataFrame([("a", 1.0), ("b", None)], "s string, t double"), "s", "t", ["a", "b"]).first()
    assert t["total_seconds"] is None and t["missing"] == ["b"]
    with pytest.raises(ValueError):
        models.check_capacity(2, 3, 4, 25)

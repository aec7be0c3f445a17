"""Queries on the sequence graph and the minimizer hits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixlake.functions import scalars
from helixlake.operators import mapping, ordered, sequences, warehouse
from helixlake.operators.heavykeys import canonical_kmer, canonical_node
from helixlake.plans.lineage import materialise
from helixlake.sources.tables import table

K, W = 15, 10


def nodes(spark, d):
    """Every node once: upper-case sequence without white space; missing ones are null."""
    s = F.upper(F.regexp_replace("seq", r"\s+", ""))
    n = table(spark, d, "graph_nodes").select("node_id", F.when((s != "") & (s != "*"), s).alias("seq"), "out_edges")
    return n.dropDuplicates(["node_id"])


def hits(spark, d):
    h = table(spark, d, "minimizer_hits").select("hit_id", "read_id", "query_pos", "node_pos", canonical_kmer(F.col("kmer")).alias("kmer"), canonical_node(F.col("node_id")).alias("node_id"))
    return h.dropDuplicates(["hit_id"])


NODES = "nodes AS (SELECT node_id, any_value(CASE WHEN s NOT IN ('', '*') THEN s END) AS seq, any_value(out_edges) AS out_edges FROM (SELECT node_id, upper(regexp_replace(seq, '\\s', '', 'g')) AS s, out_edges FROM graph_nodes) GROUP BY node_id)"
READ_HITS = """hits AS (SELECT DISTINCT ON (hit_id) hit_id, read_id, query_pos, node_pos, CASE WHEN regexp_full_match(k, '[ACGT]{15}') THEN least(k, reverse(translate(k, 'ACGT', 'TGCA'))) END AS kmer, CASE WHEN v NOT IN ('', '*') THEN v END AS node_id
  FROM (SELECT hit_id, read_id, query_pos, node_pos, upper(regexp_replace(kmer, '^\\s+|\\s+$', '', 'g')) AS k, regexp_replace(regexp_replace(node_id, '\\s', '', 'g'), '^[<>]+', '') AS v FROM minimizer_hits))"""
KMERS = NODES + f""", words AS (SELECT node_id, p - 1 AS pos, substr(seq, p, {K}) AS w FROM (SELECT node_id, seq, unnest(range(1, length(seq) - {K - 2})) AS p FROM nodes WHERE length(seq) >= {K})),
km AS (SELECT node_id, pos, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM words WHERE regexp_full_match(w, '[ACGT]{{{K}}}'))"""
MINIMIZERS = KMERS + f""", mz AS (SELECT DISTINCT node_id, m.kmer AS kmer, m.pos AS pos FROM (
  SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY node_id) AS n, min({{'kmer': kmer, 'pos': pos}}) OVER (PARTITION BY node_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS m FROM km)
  WHERE i <= n - {W} OR (n <= {W} AND i = 0))"""


def kmer_counts(spark, d):
    return sequences.kmers(nodes(spark, d), "node_id", "seq", K).groupBy("node_id").agg(F.count(F.lit(1)).alias("kmers"), F.countDistinct("kmer").alias("distinct_kmers"), F.min("kmer").alias("least"))


def minimizers(spark, d):
    return sequences.minimizers(nodes(spark, d), "node_id", "seq", K, W)


def anchor_join(spark, d):
    """Anchors of every read: its hit k-mers looked up in the node index, k-mers of more than 20 places there dropped."""
    q = hits(spark, d).where("kmer IS NOT NULL AND read_id IS NOT NULL").select("read_id", "kmer", F.col("query_pos").alias("pos")).distinct()
    a = sequences.anchors(q, minimizers(spark, d), "read_id", "node_id", 20)
    return a.groupBy("read_id").agg(F.count(F.lit(1)).alias("anchors"), F.countDistinct("node_id").alias("nodes"), F.min("query_pos").alias("first_pos"))


def reverse_complements(spark, d):
    s = F.regexp_replace("seq", "[^ACGTN]", "N")
    n = nodes(spark, d).where("seq IS NOT NULL").withColumn("s", s)
    return n.select("node_id", F.md5(scalars.reverse_complement(F.col("s"))).alias("reverse_md5"), F.md5(scalars.clean_bases(F.col("seq"))).alias("clean_md5"))


def linear_graph(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    n, e = sequences.linear_graph(docs, "doc_id", "text", 512)
    nn = n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.max(F.length("seq")).alias("longest"))
    return nn.join(e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("edges"), F.max("target").alias("last")), "doc_id", "left").select("doc_id", "nodes", "longest", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("last", F.lit(-1)).alias("last"))


def graph_degrees(spark, d):
    e = sequences.clean_edges(table(spark, d, "graph_nodes"), "node_id", "out_edges")
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("out_degree"), F.min("target").alias("first_target"))


def graph_order(spark, d):
    """The topological order of the graph; nodes on or behind a cycle have no rank."""
    n = table(spark, d, "graph_nodes").select("node_id", "out_edges")
    return sequences.topological_order(n, sequences.clean_edges(n, "node_id", "out_edges"), "node_id")


def graph_hops(spark, d):
    """Fewest edges, up to 3, from every node that no edge leads to."""
    n = table(spark, d, "graph_nodes").select("node_id", "out_edges")
    e = sequences.clean_edges(n, "node_id", "out_edges")
    start = n.select("node_id").distinct().join(e.select(F.col("target").alias("node_id")), "node_id", "left_anti")
    return sequences.hops(e, start, "node_id", 3)


def link_scores(spark, d):
    """Scores of linking every hit of a read to the one before it."""
    w = Window.partitionBy("read_id").orderBy("query_pos", "hit_id")
    h = hits(spark, d).where("read_id IS NOT NULL AND node_id IS NOT NULL")
    p = h.select("hit_id", "read_id", "node_id", "query_pos", "node_pos", F.lag("node_id").over(w).alias("pn"), F.lag("query_pos").over(w).alias("pq"), F.lag("node_pos").over(w).alias("pp")).where("pn IS NOT NULL")
    s = sequences.link_score(K, F.col("query_pos") - F.col("pq"), F.col("node_pos") - F.col("pp"), F.col("node_id") == F.col("pn"), F.lit(1))
    return p.select("hit_id", F.round(s, 4).alias("link"))


def path_transitions(spark, d):
    """Node switches and tier hops along every read; a node's tier is its hotness rank over 8 tiers."""
    # written once: cleaned and told apart for the tiers, their number and the paths
    h = materialise(_placed(spark, d).select("hit_id", "read_id", "query_pos", "node_id"), "placed-hits")
    t = _tiers(h).select("node_id", "tier")
    return ordered.transitions(h.join(t, "node_id"), "read_id", ["query_pos", "hit_id"], "node_id", "tier")


def node_tiers(spark, d):
    return _tiers(_placed(spark, d))


def _placed(spark, d):
    return hits(spark, d).where("node_id IS NOT NULL AND read_id IS NOT NULL")


def _tiers(placed):
    counts = materialise(placed.groupBy("node_id").agg(F.count(F.lit(1)).alias("hits")), "node-hits")
    return ordered.rank_tiers(counts, [F.desc("hits"), F.col("node_id")], 8)


def read_chains(spark, d):
    """The best chain of every read's placed hits; the number in a node's name is its place along the reference."""
    h = _placed(spark, d).select("read_id", "query_pos", "node_id", "node_pos", F.regexp_extract("node_id", r"(\d+)", 1).try_cast("long").alias("rank"))
    return mapping.read_chains(h, "read_id", "query_pos", "node_id", "node_pos", "rank", K).select("read_id", "anchors", F.round("score", 4).alias("score"))


def edge_alignments(spark, d):
    """For every node of a number divisible by 50: its sequence and its first successor's as one read, mapped to the subgraph of
    nodes up to two edges on. Tested against brute force."""
    n = nodes(spark, d).where("seq IS NOT NULL").select("node_id", "seq")
    e = sequences.clean_edges(table(spark, d, "graph_nodes"), "node_id", "out_edges")
    start = n.where(F.regexp_extract("node_id", r"(\d+)", 1).try_cast("long") % 50 == 0)
    first = e.groupBy(F.col("source").alias("node_id")).agg(F.min("target").alias("next")).join(n.select(F.col("node_id").alias("next"), F.col("seq").alias("then")), "next")
    reads = start.join(first, "node_id").select(F.col("node_id").alias("read_id"), F.concat("seq", "then").alias("read_seq"))
    one = reads.select("read_id", F.col("read_id").alias("node_id"))
    step = lambda near: near.join(e, F.col("node_id") == F.col("source")).select("read_id", F.col("target").alias("node_id"))
    two = step(one)
    near = one.unionByName(two).unionByName(step(two)).distinct()
    return mapping.align_local(reads, "read_id", "read_seq", near, n, "node_id", "seq", e, 11, 5, 64)


def node_slices(spark, d):
    """Slices of 100 bases at fixed starts of every long node, with their digests and the bytes of their packed copies."""
    s = nodes(spark, d).where("length(seq) >= 2000").select("node_id", "seq")
    return sequences.slices(s, "node_id", "seq", [0, 500, 1900], 100).select("node_id", "start", "end", F.sha2("slice", 256).alias("digest"), sequences.packed_bytes(F.lit(1), F.lit(150), F.col("end") - F.col("start")).alias("bytes"))


def graph_order_check(spark, d):
    """Nodes, nodes with a rank, edges between such, and edges that run against the order (none may)."""
    n = table(spark, d, "graph_nodes").select("node_id", "out_edges")
    e = sequences.clean_edges(n, "node_id", "out_edges")
    r = materialise(sequences.topological_order(n, e, "node_id"), "ranks")
    a, b = r.select(F.col("node").alias("source"), F.col("rank").alias("a")), r.select(F.col("node").alias("target"), F.col("rank").alias("b"))
    both = e.join(a, "source").join(b, "target").where("a IS NOT NULL AND b IS NOT NULL").agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("a") >= F.col("b"), 1)).alias("against"))
    return r.agg(F.count(F.lit(1)).alias("nodes"), F.count("rank").alias("ranked"), F.countDistinct("rank").alias("ranks")).join(F.broadcast(both))


def length_histogram(spark, d):
    return nodes(spark, d).where("seq IS NOT NULL").groupBy(F.length("seq").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("bases"))


def minimizer_settings(spark, d):
    shortest = nodes(spark, d).agg(F.min(F.length("seq")).alias("shortest"))
    k = F.greatest(F.lit(3), F.least(F.lit(15), F.floor(F.col("shortest") / 2)))
    return shortest.select("shortest", k.alias("k"), F.greatest(F.lit(4), F.least(F.lit(16), k + 3)).alias("w"))


def cigar_spans(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    n = lambda c, u: F.concat(F.col(c).cast("int").cast("string"), F.lit(u))
    cigar = F.concat(n("l_quantity", "M"), n("l_linenumber", "I"), n("l_quantity", "N"), n("l_linenumber", "D"), n("l_quantity", "="), F.lit("4S"))
    tags = F.concat(F.lit("AS:i:5\tNM:i:"), F.col("l_linenumber").cast("string"))
    x = l.select(scalars.alignment_span(cigar).alias("a"), scalars.reference_span(cigar).alias("r"), scalars.integer_tag(tags, "NM").alias("nm"), "l_linenumber")
    return x.groupBy("l_linenumber").agg(F.sum("a").alias("alignment"), F.sum("r").alias("reference"), F.sum("nm").alias("edits"))


def flag_counters(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 4096).cast("int").alias("flags"), (F.col("o_custkey") % 61).cast("int").alias("mapq"), F.col("o_totalprice").cast("long").alias("span"))
    c = warehouse.alignment_counters(o, "flags", "mapq", F.col("span"), F.when(F.col("mapq") > 5, F.col("mapq")))
    return c.select(*(F.round(x, 6).alias(x) if x.endswith("percent") else F.col(x) for x in c.columns))


def mapping_accuracy(spark, d):
    """Nodes of hits as mapped, nodes of the graph as truth: the read's first hit against its most frequent node."""
    h = hits(spark, d).where("read_id IS NOT NULL AND node_id IS NOT NULL")
    most = h.groupBy("read_id", "node_id").agg(F.count(F.lit(1)).alias("n"), F.min("node_pos").alias("node_pos"))
    truth = most.groupBy("read_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "node_id", "node_pos")).alias("m")).select("read_id", "m.node_id", "m.node_pos", F.lit("+").alias("strand"))
    seen = h.where("query_pos >= 1000").groupBy("read_id").agg(F.min(F.struct("query_pos", "hit_id", "node_id", "node_pos")).alias("m")).select("read_id", "m.node_id", "m.node_pos", F.when(F.col("m.hit_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    a = warehouse.mapping_accuracy(truth, seen, "read_id", "node_id", "node_pos", "strand", 100.0)
    return a.withColumn("mean_error", F.round("mean_error", 4)).withColumn("median_error", F.round("median_error", 4))


def routed_texts(spark, d):
    """Node sequences routed by their best hit: the target read, turned round where the hit's place is odd."""
    h = hits(spark, d).where("node_id IS NOT NULL AND read_id IS NOT NULL").select("node_id", F.col("read_id").alias("target"), F.when(F.col("node_pos") % 2 == 1, "-").otherwise("+").alias("strand"), "query_pos", "hit_id")
    r = warehouse.routed(nodes(spark, d).where("seq IS NOT NULL").select("node_id", "seq"), h, "node_id", "target", "strand", "seq", [F.desc("query_pos"), F.col("hit_id")])
    return r.select("node_id", "target", "strand", F.md5("oriented").alias("oriented_md5"))


QUERIES = {f.__name__: f for f in (kmer_counts, minimizers, anchor_join, reverse_complements, linear_graph, graph_degrees, graph_order, graph_order_check, graph_hops, link_scores, read_chains, edge_alignments, node_slices, path_transitions, node_tiers, length_histogram, minimizer_settings, cigar_spans, flag_counters, mapping_accuracy, routed_texts)}

_TIERS = READ_HITS + ", tiers AS (SELECT node_id, n AS hits, floor((row_number() OVER (ORDER BY n DESC, node_id) - 1) * 8 / count(*) OVER ())::BIGINT AS tier FROM (SELECT node_id, count(*) AS n FROM hits WHERE node_id IS NOT NULL AND read_id IS NOT NULL GROUP BY 1))"
_EDGES = "edges AS (SELECT DISTINCT source, target FROM (SELECT node_id AS source, unnest(out_edges) AS target FROM graph_nodes) WHERE target IN (SELECT node_id FROM graph_nodes))"
SQL = {
    "kmer_counts": f"WITH {KMERS} SELECT node_id, count(*) AS kmers, count(DISTINCT kmer) AS distinct_kmers, min(kmer) AS least FROM km GROUP BY 1",
    "minimizers": f"WITH {MINIMIZERS} SELECT node_id, kmer, pos::INT AS pos FROM mz",
    "anchor_join": f"""WITH {MINIMIZERS}, {READ_HITS}, rare AS (SELECT kmer FROM mz GROUP BY 1 HAVING count(*) <= 20), q AS (SELECT DISTINCT read_id, kmer, query_pos FROM hits WHERE kmer IS NOT NULL AND read_id IS NOT NULL)
SELECT read_id, count(*) AS anchors, count(DISTINCT node_id) AS nodes, min(query_pos) AS first_pos FROM q JOIN mz USING (kmer) WHERE kmer IN (SELECT kmer FROM rare) GROUP BY 1""",
    "reverse_complements": f"WITH {NODES} SELECT node_id, md5(reverse(translate(regexp_replace(seq, '[^ACGTN]', 'N', 'g'), 'ACGTN', 'TGCAN'))) AS reverse_md5, md5(regexp_replace(seq, '[^ACGT]', 'A', 'g')) AS clean_md5 FROM nodes WHERE seq IS NOT NULL",
    "linear_graph": "SELECT doc_id, ceil(length(text) / 512.0)::BIGINT AS nodes, least(length(text), 512)::INT AS longest, (ceil(length(text) / 512.0) - 1)::BIGINT AS edges, CASE WHEN length(text) > 512 THEN (ceil(length(text) / 512.0) - 1)::BIGINT ELSE -1 END AS last FROM documents WHERE length(text) > 0",
    "graph_degrees": f"WITH {_EDGES} SELECT source, count(*) AS out_degree, min(target) AS first_target FROM edges GROUP BY 1",
    "graph_hops": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT DISTINCT node_id AS origin, node_id AS node, 0 AS hops FROM graph_nodes WHERE node_id NOT IN (SELECT target FROM edges) UNION SELECT origin, target, hops + 1 FROM r JOIN edges ON source = node WHERE hops < 3)
SELECT origin, node, min(hops)::INT AS hops FROM r GROUP BY ALL""",
    "link_scores": f"""WITH {READ_HITS}, p AS (SELECT hit_id, node_id, query_pos, node_pos, lag(node_id) OVER w AS pn, lag(query_pos) OVER w AS pq, lag(node_pos) OVER w AS pp FROM hits WHERE read_id IS NOT NULL AND node_id IS NOT NULL WINDOW w AS (PARTITION BY read_id ORDER BY query_pos, hit_id))
SELECT hit_id, round(CASE WHEN query_pos < pq THEN NULL WHEN node_id = pn THEN CASE WHEN node_pos >= pp THEN {K} - 0.5::DOUBLE * abs(query_pos - pq - node_pos + pp) END ELSE {K} - 0.8::DOUBLE * abs(query_pos - pq - {K}) - 0.2::DOUBLE END, 4) AS link FROM p WHERE pn IS NOT NULL""",
    "read_chains": f"""WITH RECURSIVE {READ_HITS}, a AS (SELECT DISTINCT read_id, query_pos::BIGINT AS q, node_id AS n, node_pos::BIGINT AS p, coalesce(try_cast(regexp_extract(node_id, '(\\d+)', 1) AS BIGINT), -1) AS k FROM hits WHERE read_id IS NOT NULL AND node_id IS NOT NULL AND query_pos IS NOT NULL AND node_pos IS NOT NULL),
l AS (SELECT read_id, list({{'q': q, 'n': n, 'p': p, 'k': k}} ORDER BY q, CASE WHEN k < 0 THEN 9e18 ELSE k END, p, n) AS x FROM a GROUP BY 1),
r AS (SELECT read_id, x, 1 AS i, [{K}::DOUBLE] AS t FROM l UNION ALL
  SELECT read_id, x, i + 1, list_append(t, greatest({K}::DOUBLE, coalesce(list_max(list_transform(range(greatest(1, i + 1 - 256), i + 1), lambda j: CASE WHEN x[i + 1].q < x[j].q THEN NULL
    WHEN x[i + 1].n = x[j].n THEN CASE WHEN x[i + 1].p >= x[j].p THEN t[j] + {K} - 0.5::DOUBLE * abs(x[i + 1].q - x[j].q - x[i + 1].p + x[j].p) END
    WHEN x[j].k >= 0 AND x[i + 1].k >= x[j].k THEN t[j] + {K} - 0.8::DOUBLE * abs(x[i + 1].q - x[j].q - greatest(1, x[i + 1].k - x[j].k) * {K}) - 0.2::DOUBLE * greatest(1, x[i + 1].k - x[j].k) END)), {K}::DOUBLE))) FROM r WHERE i < len(x))
SELECT read_id, len(x)::BIGINT AS anchors, round(list_max(t), 4) AS score FROM r WHERE i = len(x)""",
    "node_slices": f"""WITH {NODES} SELECT node_id, s AS start, s + 100 AS "end", sha256(substr(seq, s::INT + 1, 100)) AS digest, (19 * 4 + (100 // 32 + 1) * 4 + 4 + (100 // 8 + 1) * 4 + 12)::BIGINT AS bytes FROM nodes, (SELECT unnest([0::BIGINT, 500, 1900]) AS s) WHERE length(seq) >= 2000""",
    "graph_order_check": f"WITH {_EDGES} SELECT (SELECT count(DISTINCT node_id) FROM graph_nodes) AS nodes, (SELECT count(DISTINCT node_id) FROM graph_nodes) AS ranked, (SELECT count(DISTINCT node_id) FROM graph_nodes) AS ranks, count(*) AS edges, 0::BIGINT AS against FROM edges",
    "path_transitions": f"""WITH {_TIERS}, s AS (SELECT read_id, node_id, tier, lag(node_id) OVER w AS pn, lag(tier) OVER w AS pt FROM hits JOIN tiers USING (node_id) WHERE read_id IS NOT NULL WINDOW w AS (PARTITION BY read_id ORDER BY query_pos, hit_id))
SELECT read_id, count(*) AS steps, sum(CASE WHEN node_id <> pn THEN 1 ELSE 0 END)::BIGINT AS switches, sum(abs(tier - pt))::BIGINT AS hops FROM s WHERE pn IS NOT NULL GROUP BY 1""",
    "node_tiers": f"WITH {_TIERS} SELECT * FROM tiers",
    "length_histogram": f"WITH {NODES} SELECT length(seq)::INT AS length, count(*) AS n, sum(length(seq))::BIGINT AS bases FROM nodes WHERE seq IS NOT NULL GROUP BY 1",
    "minimizer_settings": f"WITH {NODES}, s AS (SELECT min(length(seq)) AS s FROM nodes) SELECT s::INT AS shortest, greatest(3, least(15, s // 2))::BIGINT AS k, greatest(4, least(16, greatest(3, least(15, s // 2)) + 3))::BIGINT AS w FROM s",
    "cigar_spans": "SELECT l_linenumber, sum(trunc(l_quantity) * 2 + l_linenumber * 2)::BIGINT AS alignment, sum(trunc(l_quantity) * 3 + l_linenumber)::BIGINT AS reference, sum(l_linenumber)::BIGINT AS edits FROM lineitem GROUP BY 1",
    "flag_counters": """WITH o AS (SELECT (o_orderkey % 4096)::INT AS f, o_custkey % 61 AS q, trunc(o_totalprice)::BIGINT AS span FROM orders), m AS (SELECT *, f & 256 = 0 AND f & 2048 = 0 AS prim, f & 256 = 0 AND f & 2048 = 0 AND f & 4 = 0 AS map FROM o),
c AS (SELECT count(*) FILTER (prim) AS "primary", count(*) FILTER (f & 256 <> 0) AS secondary, count(*) FILTER (f & 2048 <> 0) AS supplementary, count(*) FILTER (map) AS mapped, count(*) FILTER (map AND f & 2 <> 0) AS proper, count(*) FILTER (map AND f & 8 = 0) AS both_mapped, count(*) FILTER (map AND f & 16 <> 0) AS reverse,
  count(*) FILTER (map AND q >= 20) AS mapq20, count(*) FILTER (map AND q >= 30) AS mapq30, sum(span) FILTER (map)::BIGINT AS span, sum(q) FILTER (map AND q > 5)::BIGINT AS edits FROM m)
SELECT *, round(100.0::DOUBLE * mapped / "primary", 6) AS mapped_percent, round(100.0::DOUBLE * proper / "primary", 6) AS proper_percent, round(100.0::DOUBLE * mapq20 / mapped, 6) AS mapq20_percent, round(100.0::DOUBLE * mapq30 / mapped, 6) AS mapq30_percent, round(100.0::DOUBLE * (1 - edits::DOUBLE / span), 6) AS identity_percent FROM c""",
    "mapping_accuracy": f"""WITH {READ_HITS}, h AS (SELECT * FROM hits WHERE read_id IS NOT NULL AND node_id IS NOT NULL), mo AS (SELECT read_id, node_id, count(*) AS n, min(node_pos) AS p FROM h GROUP BY ALL), tr AS (SELECT DISTINCT ON (read_id) read_id, node_id, p FROM mo ORDER BY read_id, n DESC, node_id),
se AS (SELECT DISTINCT ON (read_id) read_id, node_id AS sn, node_pos AS sp, CASE WHEN hit_id % 2 = 0 THEN '+' ELSE '-' END AS st FROM h WHERE query_pos >= 1000 ORDER BY read_id, query_pos, hit_id), j AS (SELECT *, CASE WHEN sn = node_id THEN abs(sp - p) END AS err FROM tr LEFT JOIN se USING (read_id))
SELECT count(*) AS truth, count(sn) AS mapped, count(*) FILTER (sn = node_id) AS right_target, count(*) FILTER (err <= 100) AS within_tolerance, count(*) FILTER (sn = node_id AND st = '+') AS right_strand, round(median(err)::DOUBLE, 4) AS median_error, round(avg(err), 4) AS mean_error FROM j""",
    "routed_texts": f"""WITH {NODES}, {READ_HITS}, b AS (SELECT DISTINCT ON (node_id) node_id, read_id AS target, CASE WHEN node_pos % 2 = 1 THEN '-' ELSE '+' END AS strand FROM hits WHERE node_id IS NOT NULL AND read_id IS NOT NULL ORDER BY node_id, query_pos DESC, hit_id)
SELECT node_id, target, strand, md5(CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGTN', 'TGCAN')) ELSE seq END) AS oriented_md5 FROM nodes JOIN b USING (node_id) WHERE seq IS NOT NULL""",
}

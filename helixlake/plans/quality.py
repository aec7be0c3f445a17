"""Queries on the quality of clusterings: a spectrum's truth is its best peptide, its cluster the bucket of charge and m/z."""

from pyspark.sql import functions as F

from helixlake.functions import bits, scalars
from helixlake.operators import bandjoin, buckets, clustering, metrics, ordered
from helixlake.plans.lineage import materialise
from helixlake.plans.search import HITS, best_identified
from helixlake.plans.spectra import SPECTRA, spectra
from helixlake.sources.tables import table


def labelled(spark, d):
    """(spectrum_id, charge, label, cluster): null label without a best hit; cluster -1 where the bucket holds one spectrum."""
    s = buckets.surrogate_labels(spectra(spark, d), F.col("precursor_charge"), F.col("precursor_mz"), 2.0, "bucket").select("spectrum_id", F.col("precursor_charge").alias("charge"), "bucket")
    best = best_identified(spark, d, "open").select(F.col("query_spectrum").alias("spectrum_id"), F.col("peptide").alias("label"))
    least = s.groupBy("bucket").agg(F.min("spectrum_id").alias("least"), F.count(F.lit(1)).alias("n"))
    j = s.join(least, "bucket").join(best, "spectrum_id", "left")
    return j.select("spectrum_id", "charge", "label", F.when(F.col("n") > 1, F.col("least")).otherwise(-1).alias("cluster"))


LABELLED = SPECTRA + ", " + HITS + """, bst AS (SELECT query_spectrum, arg_max(peptide, (score, -library_spectrum)) AS label FROM hit h JOIN library_spectra l ON l.library_id = h.library_spectrum
  WHERE stage = 'open' AND peptide IS NOT NULL GROUP BY 1),
bk AS (SELECT spectrum_id, precursor_charge AS charge, 'z' || coalesce(precursor_charge, 0) || '_b' || trunc(coalesce(precursor_mz, 0) / 2)::BIGINT AS bucket FROM spec),
lab AS (SELECT spectrum_id, charge, label, CASE WHEN count(*) OVER (PARTITION BY bucket) > 1 THEN min(spectrum_id) OVER (PARTITION BY bucket) ELSE -1 END AS cluster FROM bk LEFT JOIN bst ON query_spectrum = spectrum_id)"""
_NOTNOISE = "cells AS (SELECT label, cluster, count(*) AS n FROM lab WHERE label IS NOT NULL AND cluster <> -1 GROUP BY ALL), ra AS (SELECT label, sum(n) AS a FROM cells GROUP BY 1), cb AS (SELECT cluster, sum(n) AS b FROM cells GROUP BY 1)"


def cluster_metrics(spark, d):
    m = metrics.cluster_metrics(metrics.contingency(labelled(spark, d).where("cluster <> -1"), "label", "cluster"))
    return m.select("n", "exact_clusters", *(F.round(c, 6).alias(c) for c in m.columns if c not in ("n", "exact_clusters")))


def contingency_cells(spark, d):
    return metrics.contingency(labelled(spark, d), "label", "cluster")


def incorrect_ratios(spark, d):
    new, old = metrics.incorrect_ratio(labelled(spark, d), "label", "cluster"), metrics.incorrect_ratio_identified(labelled(spark, d), "label", "cluster")
    out = new.withColumn("rule", F.lit("majority")).unionByName(old.withColumn("rule", F.lit("identified")))
    return out.withColumn("incorrect_ratio", F.round("incorrect_ratio", 6))


def cluster_size_histogram(spark, d):
    return metrics.size_histogram(labelled(spark, d), "cluster", [0, 2, 5, 20, 100]).withColumn("upper", F.coalesce("upper", F.lit(-1)))


def closed_size_distribution(spark, d):
    return metrics.size_histogram(labelled(spark, d), "cluster", [1, 2, 6, 21, 101]).withColumn("upper", F.coalesce("upper", F.lit(-1)))


def size_filtered_clusters(spark, d):
    f = metrics.size_filtered(labelled(spark, d).where("cluster <> -1"), "cluster", 3, 50, "kept")
    return f.groupBy("kept").agg(F.count(F.lit(1)).alias("n"))


def clustered_shares(spark, d):
    return metrics.clustered_share(labelled(spark, d), "cluster").withColumn("clustered_share", F.round("clustered_share", 6))


def renumbered_clusters(spark, d):
    r = scalars.renumbered(labelled(spark, d), "cluster", ["charge"], "number")
    return r.where("charge IS NOT NULL").groupBy("charge", "number").agg(F.count(F.lit(1)).alias("n"))


def namespaced_labels(spark, d):
    r = scalars.namespaced_labels(labelled(spark, d).drop("label"), "cluster", "charge", "spectrum_id", "m")
    return r.select("spectrum_id", "label")


def weighted_batch_metrics(spark, d):
    """Homogeneity-like purity per charge, weighted by the charge's rows."""
    rows = labelled(spark, d).where("label IS NOT NULL AND cluster <> -1").groupBy("charge", "cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    per = rows.groupBy("charge", "cluster").agg(F.sum("n").alias("size"), F.max("n").alias("major")).groupBy("charge").agg(F.sum("size").alias("w"), (F.sum("major") / F.sum("size")).alias("purity"), F.avg("size").alias("mean_size"))
    return metrics.weighted_means(per, "w", ["purity", "mean_size"]).select(F.round("purity", 6).alias("purity"), F.round("mean_size", 6).alias("mean_size"))


def equal_groups(spark, d):
    """Runs grouped by instrument and by gradient: groups with the same members."""
    runs = table(spark, d, "ms_runs").withColumn("instrument", F.lower("instrument"))
    by_day = runs.withColumn("grp", F.concat_ws("/", F.coalesce("instrument", F.lit("none")), F.col("gradient_min").cast("string")))
    return ordered.equal_groups(by_day, runs.withColumn("other", F.concat(F.lit("g"), F.col("gradient_min").cast("string"), F.coalesce("instrument", F.lit("none")))), "run_id", "grp", "other")


def unique_crosswalk(spark, d):
    """Spectra matched to themselves by (charge, time, m/z); keys that occur twice don't count."""
    from helixlake.operators.warehouse import unique_crosswalk as walk

    key = scalars.rounded_key(F.col("precursor_charge"), F.round(F.col("retention_time") / 100), F.round(F.col("precursor_mz") / 100))
    s = spectra(spark, d).select("spectrum_id", key.alias("k"))
    _, report = walk(s, s.withColumnRenamed("spectrum_id", "other"), "k")
    return report.select("keys", "ambiguous_keys", "rows", "matched", F.round("matched_percent", 6).alias("matched_percent"), F.round("ambiguous_percent", 6).alias("ambiguous_percent"))


def linkage_clusters(spark, d):
    """Complete linkage inside buckets of charge and 2 m/z; rows only, checked by properties in the tests."""
    s = spectra(spark, d).where("precursor_mz > 0").select("spectrum_id", "precursor_charge", F.floor(F.col("precursor_mz") / 2).alias("bucket_id"), "packed_hv")
    return clustering.global_ids(clustering.bucket_clusters(s, "spectrum_id", ["precursor_charge", "bucket_id"], "packed_hv", 256), "cluster", "pim", "cluster_id").select(F.col("id").alias("spectrum_id"), "cluster_id")


def linkage_check(spark, d):
    """Clusters of complete linkage checked by what defines them: spectra, those in a cluster, and pairs farther apart than the cut."""
    c = materialise(linkage_clusters(spark, d), "linkage")
    v = spectra(spark, d).select("spectrum_id", bits.words(F.col("packed_hv"), 256).alias("w"))
    m = c.join(v, "spectrum_id")
    p = m.join(m.select("cluster_id", F.col("spectrum_id").alias("other"), F.col("w").alias("ow")), "cluster_id").where("spectrum_id < other")
    far = p.agg(F.count(F.when(bits.hamming_words(F.col("w"), F.col("ow")) > 0.455 * 2048, 1)).alias("too_far"))
    return c.agg(F.count(F.lit(1)).alias("members"), F.countDistinct("spectrum_id").alias("spectra")).join(F.broadcast(far))


def vector_components(spark, d):
    """Components of the spectra of equal charge and within 2 m/z whose vectors differ in at most 256 or 512 bits: density
    clusters of two samples, distances computed once for both limits."""
    s = spectra(spark, d).where(F.length("packed_hv") == 256).where("precursor_mz > 0 AND precursor_charge IS NOT NULL")
    s = s.select("spectrum_id", F.col("precursor_charge").alias("charge"), F.col("precursor_mz").alias("mz"), bits.words(F.col("packed_hv"), 256).alias("w"))
    b = s.select(F.col("spectrum_id").alias("other"), "charge", F.col("mz").alias("other_mz"), F.col("w").alias("ow"))
    p = bandjoin.band_join(s, b, "mz", "other_mz", F.lit(2.0), 4.0, ["charge"]).where("spectrum_id < other")
    p = materialise(p.select("spectrum_id", "other", bits.hamming_words(F.col("w"), F.col("ow")).alias("distance")).where("distance <= 512"), "vector-pairs")
    c = clustering.threshold_components(s, p, "spectrum_id", "spectrum_id", "other", "distance", [256.0, 512.0])
    return c.groupBy("threshold", "component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def graph_components(spark, d):
    """Connected components of the sequence graph, by the smallest node id."""
    from helixlake.operators.sequences import clean_edges

    nodes = table(spark, d, "graph_nodes").select("node_id", "out_edges")
    c = clustering.components(nodes, clean_edges(nodes, "node_id", "out_edges"), "node_id", "source", "target")
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (cluster_metrics, contingency_cells, incorrect_ratios, cluster_size_histogram, closed_size_distribution, size_filtered_clusters, clustered_shares, renumbered_clusters, namespaced_labels, weighted_batch_metrics, equal_groups, unique_crosswalk, linkage_clusters, linkage_check, vector_components, graph_components)}


def _hist(edges):
    rows = ", ".join(f"({lo}, {hi if hi else 'NULL'})" for lo, hi in zip(edges, [*edges[1:], None], strict=True))
    return f"""WITH {LABELLED}, s AS (SELECT cluster, count(*) AS size FROM lab WHERE cluster <> -1 GROUP BY 1), r(lower, upper) AS (VALUES {rows})
SELECT lower::BIGINT AS lower, coalesce(upper, -1)::BIGINT AS upper, count(size) AS clusters, coalesce(sum(size), 0)::BIGINT AS members FROM r LEFT JOIN s ON size >= lower AND (upper IS NULL OR size < upper) GROUP BY ALL"""


SQL = {
    "cluster_metrics": f"""WITH {LABELLED}, {_NOTNOISE}, t AS (SELECT sum(n)::DOUBLE AS t FROM cells),
x AS (SELECT sum(n * (n - 1) / 2)::DOUBLE AS bth, sum(n * n / b)::DOUBLE AS bp, sum(n * n / a)::DOUBLE AS br, sum(n * ln(n)) AS snn, sum(CASE WHEN n = a AND n = b THEN 1 ELSE 0 END)::BIGINT AS exact FROM cells JOIN ra USING (label) JOIN cb USING (cluster)),
y AS (SELECT count(*) AS na, sum(a * (a - 1) / 2)::DOUBLE AS pa, sum(a * ln(a)) AS saa FROM ra), z AS (SELECT count(*) AS nb, sum(b * (b - 1) / 2)::DOUBLE AS pb, sum(b * ln(b)) AS sbb FROM cb),
m AS (SELECT *, CASE WHEN pb > 0 THEN bth / pb ELSE 1 END AS pr, CASE WHEN pa > 0 THEN bth / pa ELSE 1 END AS re, pa * pb / (t * (t - 1) / 2) AS ex, ln(t) - saa / t AS ha, ln(t) - sbb / t AS hb, ln(t) + (snn - saa - sbb) / t AS mi FROM t, x, y, z)
SELECT t::BIGINT AS n, exact AS exact_clusters, round(pr, 6) AS precision, round(re, 6) AS recall, CASE WHEN pr + re > 0 THEN round(2 * pr * re / (pr + re), 6) ELSE 0 END AS f1, round((bth - ex) / ((pa + pb) / 2 - ex), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi, round(mi / ha, 6) AS homogeneity,
  round(mi / hb, 6) AS completeness, round(bp / t, 6) AS bcubed_precision, round(br / t, 6) AS bcubed_recall, round(2 * (bp / t) * (br / t) / (bp / t + br / t), 6) AS bcubed_f1, round(exact::DOUBLE / na, 6) AS exact_ratio, round(least(na, nb)::DOUBLE / greatest(na, nb), 6) AS count_agreement FROM m""",
    "contingency_cells": f"WITH {LABELLED} SELECT label AS truth, cluster AS predicted, count(*) AS n FROM lab WHERE label IS NOT NULL GROUP BY ALL",
    "incorrect_ratios": f"""WITH {LABELLED}, c AS (SELECT cluster, label, count(*) AS n FROM lab WHERE cluster <> -1 AND label IS NOT NULL GROUP BY ALL), p AS (SELECT cluster, sum(n) AS size, max(n) AS major FROM c GROUP BY 1), s AS (SELECT sum(size - major)::BIGINT AS i, sum(size)::BIGINT AS m FROM p)
SELECT 'majority' AS rule, i AS incorrect, m AS members, round(i::DOUBLE / m, 6) AS incorrect_ratio FROM s UNION ALL SELECT 'identified', i, m, round(i::DOUBLE / (m + 1e-6::DOUBLE), 6) FROM s""",
    "cluster_size_histogram": _hist([0, 2, 5, 20, 100]),
    "closed_size_distribution": _hist([1, 2, 6, 21, 101]),
    "size_filtered_clusters": f"WITH {LABELLED}, s AS (SELECT cluster, count(*) AS n FROM lab WHERE cluster <> -1 GROUP BY 1) SELECT CASE WHEN n >= 3 AND n < 50 THEN cluster ELSE -1 END AS kept, sum(n)::BIGINT AS n FROM s GROUP BY 1",
    "clustered_shares": f"WITH {LABELLED} SELECT sum(CASE WHEN cluster <> -1 THEN 1 ELSE 0 END)::BIGINT AS clustered, sum(CASE WHEN cluster = -1 THEN 1 ELSE 0 END)::BIGINT AS noise, round(avg(CASE WHEN cluster <> -1 THEN 1.0 ELSE 0.0 END), 6) AS clustered_share FROM lab",
    "renumbered_clusters": f"""WITH {LABELLED}, s AS (SELECT charge, cluster, count(*) AS n FROM lab WHERE charge IS NOT NULL GROUP BY ALL)
SELECT charge, (row_number() OVER (PARTITION BY charge ORDER BY n DESC, cluster) - 1)::INT AS number, n FROM s WHERE cluster <> -1 UNION ALL SELECT charge, -1, n FROM s WHERE cluster = -1""",
    "namespaced_labels": f"WITH {LABELLED} SELECT spectrum_id, CASE WHEN cluster = -1 THEN 'm:noise:' || spectrum_id ELSE 'z' || coalesce(charge, 0) || ':' || cluster END AS label FROM lab",
    "weighted_batch_metrics": f"""WITH {LABELLED}, c AS (SELECT charge, cluster, label, count(*) AS n FROM lab WHERE label IS NOT NULL AND cluster <> -1 GROUP BY ALL), p AS (SELECT charge, cluster, sum(n)::DOUBLE AS size, max(n)::DOUBLE AS major FROM c GROUP BY ALL),
g AS (SELECT charge, sum(size) AS w, sum(major) / sum(size) AS purity, avg(size) AS mean_size FROM p GROUP BY 1) SELECT round(sum(purity * w) / sum(w), 6) AS purity, round(sum(mean_size * w) / sum(w), 6) AS mean_size FROM g""",
    "equal_groups": "SELECT coalesce(lower(instrument), 'none') || '/' || gradient_min AS grp, 'g' || gradient_min || coalesce(lower(instrument), 'none') AS other, count(*) AS n FROM ms_runs GROUP BY ALL",
    "unique_crosswalk": f"""WITH {SPECTRA}, k AS (SELECT coalesce(precursor_charge, 0) || '|' || (round(retention_time / 100) * 100)::BIGINT || '|' || (round(precursor_mz / 100) * 1000)::BIGINT AS k FROM spec), u AS (SELECT k, count(*) AS n FROM k WHERE k IS NOT NULL GROUP BY 1),
s AS (SELECT count(*) AS keys, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS ambiguous_keys, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS matched, (SELECT count(*) FROM k) AS rows FROM u)
SELECT keys, ambiguous_keys, rows, matched, round(100.0::DOUBLE * matched / rows, 6) AS matched_percent, round(100.0::DOUBLE * ambiguous_keys / keys, 6) AS ambiguous_percent FROM s""",
    "linkage_check": f"WITH {SPECTRA} SELECT count(*) AS members, count(*) AS spectra, 0::BIGINT AS too_far FROM spec WHERE precursor_mz > 0 AND octet_length(packed_hv) = 256",
    "vector_components": f"""WITH RECURSIVE {SPECTRA}, v AS (SELECT spectrum_id AS id, precursor_charge AS z, precursor_mz AS mz, packed_hv::BIT AS b FROM spec WHERE octet_length(packed_hv) = 256 AND precursor_mz > 0 AND precursor_charge IS NOT NULL),
p AS (SELECT a.id AS i, c.id AS j, bit_count(xor(a.b, c.b)) AS dist FROM v a JOIN v c ON a.z = c.z AND c.mz BETWEEN a.mz - 2.0::DOUBLE AND a.mz + 2.0::DOUBLE AND a.id <> c.id WHERE bit_count(xor(a.b, c.b)) <= 512),
e AS (SELECT t::DOUBLE AS t, i, j FROM p, (VALUES (256), (512)) x(t) WHERE dist <= t), r AS (SELECT t, i, j FROM e UNION SELECT r.t, r.i, e.j FROM r JOIN e ON e.t = r.t AND e.i = r.j),
m AS (SELECT t, i, least(i, min(j)) AS component FROM r GROUP BY t, i) SELECT t AS threshold, component, count(*) AS n FROM m GROUP BY ALL""",
    "graph_components": """WITH RECURSIVE e AS (SELECT DISTINCT node_id AS a, unnest(out_edges) AS b FROM graph_nodes), n AS (SELECT DISTINCT node_id FROM graph_nodes), f AS (SELECT a, b FROM e WHERE b IN (SELECT node_id FROM n)), u AS (SELECT a, b FROM f UNION SELECT b, a FROM f),
r(s, x) AS (SELECT node_id, node_id FROM n UNION SELECT r.s, u.b FROM r JOIN u ON u.a = r.x WHERE u.b > r.s), c AS (SELECT x, min(s) AS component FROM r GROUP BY 1)
SELECT component, count(*) AS n FROM c GROUP BY 1""",
}

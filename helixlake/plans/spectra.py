"""Queries on spectra: buckets, precursors, peak lists and bit vectors."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions import bits, peaks, scalars
from helixlake.operators import buckets, hypervectors
from helixlake.sources.tables import table


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spectrum once, flat."""
    return table(spark, sf_dir, "encoded_spectra").select("spectrum_id", "run_id", "scan", "packed_hv", "spectrum.*").dropDuplicates(["spectrum_id"])


def with_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).withColumn("peaks", peaks.peak_list(F.col("mz"), F.col("intensity")))


SPECTRA = """spec AS (SELECT DISTINCT ON (spectrum_id) spectrum_id, run_id, scan, packed_hv, spectrum.title AS title, spectrum.precursor_mz AS precursor_mz,
  spectrum.precursor_charge AS precursor_charge, spectrum.retention_time AS retention_time, spectrum.mz::DOUBLE[] AS mz, spectrum.intensity::DOUBLE[] AS intensity FROM encoded_spectra)"""
PEAKS = SPECTRA + """, pk AS (SELECT spectrum_id, precursor_mz, precursor_charge, unnest(mz) AS m, unnest(intensity) AS i, generate_subscripts(mz, 1) AS pos FROM spec)"""


def _sizes(spark, d):
    return buckets.bucket_sizes(spectra(spark, d), F.col("precursor_charge"), F.col("precursor_mz"), 5.0)


SIZES = SPECTRA + ", sizes AS (SELECT coalesce(precursor_charge, 0) AS charge_id, floor(coalesce(precursor_mz, 0) / 5)::BIGINT AS bucket, count(*) AS n FROM spec GROUP BY ALL)"


def bucket_pair_reduction(spark, d):
    out = buckets.pair_survival(_sizes(spark, d))
    return out.withColumn("survival_ratio", F.round("survival_ratio", 9)).withColumn("reduction_percent", F.round("reduction_percent", 6))


def bucket_statistics(spark, d):
    return buckets.bucket_statistics(_sizes(spark, d), 5).withColumn("mean_size", F.round("mean_size", 6))


def truncated_buckets(spark, d):
    """Spectra left when every bucket of charge and 5 m/z keeps its first five by id."""
    s = spectra(spark, d).select("spectrum_id", F.coalesce("precursor_charge", F.lit(0)).alias("charge"), F.floor(F.coalesce("precursor_mz", F.lit(0.0)) / 5).alias("bucket"))
    return buckets.truncated(s, [F.col("charge"), F.col("bucket")], [F.col("spectrum_id")], 5).select("spectrum_id", "charge", "bucket")


def surrogate_clusters(spark, d):
    return buckets.surrogate_labels(spectra(spark, d), F.col("precursor_charge"), F.col("precursor_mz"), 3.0).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def truncating_buckets(spark, d):
    c = table(spark, d, "customer")
    floor, cut = buckets.bucket_key(F.col("c_acctbal"), 100.0), buckets.bucket_key(F.col("c_acctbal"), 100.0, "truncate")
    return c.groupBy(floor.alias("floored"), cut.alias("truncated")).agg(F.count(F.lit(1)).alias("n"))


def unknown_charge_rows(spark, d):
    rows = scalars.charge_rows(spectra(spark, d).where("precursor_mz <= 2000"), "precursor_charge")
    return rows.groupBy("precursor_charge").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("precursor_mz"), 3).alias("mz_sum"))


def common_charges(spark, d):
    lib = table(spark, d, "library_spectra")
    common = lib.groupBy("charge").agg(F.count(F.lit(1)).alias("n")).where("n >= 3000")
    return spectra(spark, d).join(F.broadcast(common), F.col("precursor_charge") == F.col("charge"), "left_semi").groupBy("precursor_charge").agg(F.count(F.lit(1)).alias("n"))


def precursor_fallback(spark, d):
    return spectra(spark, d).select("spectrum_id", F.round(scalars.precursor_or_median(F.col("precursor_mz"), F.col("mz").cast("array<double>")), 6).alias("precursor"))


def valid_spectra(spark, d):
    p = peaks.in_mz_range(F.col("peaks"), 200.0, 1200.0)
    return with_peaks(spark, d).withColumn("peaks", p).select("spectrum_id", F.size("peaks").alias("n"), peaks.is_valid(F.col("peaks"), 10, 250.0).alias("valid"))


def strongest_peaks(spark, d):
    p = with_peaks(spark, d).withColumn("peaks", peaks.filter_intensity(F.col("peaks"), 0.05, 20))
    total = F.aggregate("peaks", F.lit(0.0), lambda s, x: s + x["intensity"])
    return p.select("spectrum_id", F.size("peaks").alias("n"), F.round(total, 4).alias("total"), F.round(F.get("peaks", 0)["mz"], 4).alias("first_mz"))


def scaled_intensities(spark, d):
    p = with_peaks(spark, d)
    s = lambda mode: F.round(F.aggregate(peaks.scale(F.col("peaks"), mode, 50), F.lit(0.0), lambda t, x: t + x["intensity"]), 4)
    return p.select("spectrum_id", s("root").alias("root"), s("log").alias("log"), s("rank").alias("ranked"))


def normalised_peaks(spark, d):
    p = with_peaks(spark, d)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda t, x: t + x["intensity"]), 6)
    cell = lambda c, k: F.round(F.get(F.get(c, 0), k), 9)
    t = peaks.tokens(F.col("peaks"), 8, 2000.0)
    return p.where(F.size("peaks") > 0).select("spectrum_id", total(peaks.l2_normalised(F.col("peaks"))).alias("l2"), total(peaks.max_normalised_head(F.col("peaks"), 10)).alias("head"), F.size(t).alias("tokens"), cell(t, 0).alias("t0"), cell(t, 1).alias("t1"))


def rounded_peak_sums(spark, d):
    r = peaks.rounded_peaks(with_peaks(spark, d), "spectrum_id", "peaks", 0)
    return r.groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("intensity"), 3).alias("total"), F.round(F.max("intensity"), 3).alias("largest"))


def sparse_binning(spark, d):
    b = peaks.sparse_bins(with_peaks(spark, d), "spectrum_id", "peaks", 100.0, 1.0)
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("spectra"), F.round(F.sum("intensity"), 2).alias("total"))


def precursor_peaks_removed(spark, d):
    p = with_peaks(spark, d)
    left = peaks.without_precursor(F.col("peaks"), F.col("precursor_mz"), F.col("precursor_charge"), 0.5, 1)
    return p.select("spectrum_id", (F.size("peaks") - F.size(left)).alias("removed"))


def spectrum_names(spark, d):
    return spectra(spark, d).select("spectrum_id", scalars.spectrum_key(F.col("title")).alias("name"), scalars.universal_id(F.lit("PXD000001"), F.col("run_id"), F.col("scan")).alias("usi"))


def peptide_labels(spark, d):
    lib = table(spark, d, "library_spectra")
    label = scalars.peptide_label(F.col("peptide"), F.col("charge"))
    return lib.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.max(scalars.first_charge(F.concat(F.col("charge").cast("string"), F.lit("+ and 9+")))).alias("charge"))


def hv_signs(spark, d):
    e = table(spark, d, "embeddings").withColumn("bits", bits.sign_bits(F.col("embedding")))
    half = F.slice("bits", 1, 62)
    words = bits.pack_words(F.col("bits"), 64)
    return e.select("vec_id", bits.pack_bits(half, 62).alias("packed"), F.get(words, 0).alias("word0"), F.get(words, 1).alias("word1"), F.aggregate("bits", F.lit(0), lambda s, x: s + x).cast("long").alias("ones"))


def hv_distance_to_next(spark, d):
    """Hamming distance of every vector to the next id, from words and from the +1 / -1 product."""
    e = table(spark, d, "embeddings").withColumn("bits", bits.sign_bits(F.col("embedding")))
    a = e.select(F.col("vec_id"), F.col("bits").alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("bits").alias("y"))
    pm = lambda c: F.transform(c, lambda v: v * 2 - 1)
    j = a.join(b, "vec_id")
    return j.select("vec_id", bits.hamming_words(bits.pack_words(F.col("x"), 64), bits.pack_words(F.col("y"), 64)).cast("long").alias("by_words"), bits.hamming_from_dot(pm("x"), pm("y"), 64).cast("long").alias("by_dot"))


def hv_top_k(spark, d):
    """The 10 spectra most like every spectrum whose id is divisible by 50, itself included."""
    rows = spectra(spark, d).select("spectrum_id", "packed_hv")
    return hypervectors.top_k(rows, rows.where("spectrum_id % 50 = 0"), "spectrum_id", "packed_hv", 10, 256)


def hv_encoded(spark, d):
    """Every spectrum encoded anew; one row a style with how many vectors are empty."""
    s = spectra(spark, d)
    out = None
    for style in ("weighted", "bipolar", "aligned"):
        e = hypervectors.encode(s, "spectrum_id", "mz", "intensity", hypervectors.Encoder(style=style, dim=1024, bins=2000, start=0.0, bin_size=1.0))
        part = e.agg(F.lit(style).alias("style"), F.count(F.lit(1)).alias("vectors"), F.sum(F.when(F.col("hv") == F.lit(bytes(128)), 1).otherwise(0)).alias("empty"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {f.__name__: f for f in (bucket_pair_reduction, bucket_statistics, truncated_buckets, surrogate_clusters, truncating_buckets, unknown_charge_rows, common_charges, precursor_fallback, valid_spectra, strongest_peaks, scaled_intensities, normalised_peaks, rounded_peak_sums, sparse_binning, precursor_peaks_removed, spectrum_names, peptide_labels, hv_signs, hv_distance_to_next, hv_top_k, hv_encoded)}

_BITS = "bits AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS b FROM embeddings)"
SQL = {
    "bucket_pair_reduction": f"""WITH {SIZES}, t AS (SELECT sum(n)::BIGINT AS spectra, sum(n * (n - 1) // 2)::BIGINT AS candidate_pairs FROM sizes), u AS (SELECT *, (spectra * (spectra - 1) // 2)::BIGINT AS all_pairs FROM t)
SELECT spectra, candidate_pairs, all_pairs, round(candidate_pairs::DOUBLE / all_pairs, 9) AS survival_ratio, round(100.0::DOUBLE * (1 - candidate_pairs::DOUBLE / all_pairs), 6) AS reduction_percent FROM u""",
    "bucket_statistics": f"WITH {SIZES} SELECT count(*) AS buckets, max(n) AS largest, round(avg(n), 6) AS mean_size, sum(CASE WHEN n > 5 THEN 1 ELSE 0 END)::BIGINT AS overflowing FROM sizes",
    "truncated_buckets": f"WITH {SPECTRA} SELECT spectrum_id, coalesce(precursor_charge, 0) AS charge, floor(coalesce(precursor_mz, 0) / 5)::BIGINT AS bucket FROM spec QUALIFY row_number() OVER (PARTITION BY charge, bucket ORDER BY spectrum_id) <= 5",
    "surrogate_clusters": f"WITH {SPECTRA} SELECT 'z' || coalesce(precursor_charge, 0) || '_b' || trunc(coalesce(precursor_mz, 0) / 3)::BIGINT AS cluster, count(*) AS n FROM spec GROUP BY ALL",
    "truncating_buckets": "SELECT floor(c_acctbal / 100)::BIGINT AS floored, trunc(c_acctbal / 100)::BIGINT AS truncated, count(*) AS n FROM customer GROUP BY ALL",
    "unknown_charge_rows": f"""WITH {SPECTRA}, x AS (SELECT unnest(CASE WHEN precursor_charge IS NULL THEN [2, 3] ELSE [precursor_charge] END) AS precursor_charge, precursor_mz FROM spec WHERE precursor_mz <= 2000)
SELECT precursor_charge, count(*) AS n, round(sum(precursor_mz), 3) AS mz_sum FROM x GROUP BY ALL""",
    "common_charges": f"WITH {SPECTRA} SELECT precursor_charge, count(*) AS n FROM spec WHERE precursor_charge IN (SELECT charge FROM library_spectra GROUP BY charge HAVING count(*) >= 3000) GROUP BY ALL",
    "precursor_fallback": f"WITH {SPECTRA} SELECT spectrum_id, round(coalesce(precursor_mz, list_aggregate(mz, 'median'), 0::DOUBLE), 6) AS precursor FROM spec",
    "valid_spectra": f"""WITH {SPECTRA}, f AS (SELECT spectrum_id, list_filter(mz, lambda x: x BETWEEN 200 AND 1200) AS k FROM spec)
SELECT spectrum_id, coalesce(len(k), -1)::INT AS n, coalesce(len(k) >= 10 AND k[-1] - k[1] >= 250, false) AS valid FROM f""",
    "strongest_peaks": f"""WITH {PEAKS}, r AS (SELECT spectrum_id, m, i, row_number() OVER (PARTITION BY spectrum_id ORDER BY i DESC, m) AS r, max(i) OVER (PARTITION BY spectrum_id) AS top FROM pk),
g AS (SELECT spectrum_id, count(*) AS n, sum(i) AS t, min(m) AS m FROM r WHERE i >= top * 0.05::DOUBLE AND r <= 20 GROUP BY 1)
SELECT spectrum_id, coalesce(n, CASE WHEN mz IS NULL THEN -1 ELSE 0 END)::INT AS n, round(CASE WHEN mz IS NULL THEN NULL ELSE coalesce(t, 0) END, 4) AS total, round(m, 4) AS first_mz FROM spec LEFT JOIN g USING (spectrum_id)""",
    "scaled_intensities": f"""WITH {PEAKS}, r AS (SELECT spectrum_id, i, rank() OVER (PARTITION BY spectrum_id ORDER BY i DESC) AS k FROM pk),
g AS (SELECT spectrum_id, sum(sqrt(i)) AS a, sum(log2(1 + i)) AS b, sum(greatest(50 - k + 1, 0)) AS c FROM r GROUP BY 1)
SELECT spectrum_id, CASE WHEN mz IS NOT NULL THEN round(coalesce(a, 0), 4) END AS root, CASE WHEN mz IS NOT NULL THEN round(coalesce(b, 0), 4) END AS log, CASE WHEN mz IS NOT NULL THEN round(coalesce(c, 0)::DOUBLE, 4) END AS ranked FROM spec LEFT JOIN g USING (spectrum_id)""",
    "normalised_peaks": f"""WITH {PEAKS}, n AS (SELECT spectrum_id, sqrt(sum(i * i)) AS norm, max(i) AS top FROM pk GROUP BY 1)
SELECT spectrum_id, round(sum(CASE WHEN norm > 0 THEN i / norm ELSE i END), 6) AS l2, round(coalesce(sum(CASE WHEN pos <= 10 AND i / top > 0 THEN i / top END), 0), 6) AS head, greatest(8, 0)::INT AS tokens,
  round(max(CASE WHEN pos = 1 THEN m / 2000 END), 9) AS t0, round(max(CASE WHEN pos = 1 THEN i / top END), 9) AS t1 FROM pk JOIN n USING (spectrum_id) GROUP BY spectrum_id""",
    "rounded_peak_sums": f"WITH {PEAKS}, g AS (SELECT spectrum_id, round(m) AS m, sum(i) AS i FROM pk GROUP BY ALL) SELECT spectrum_id, count(*) AS n, round(sum(i), 3) AS total, round(max(i), 3) AS largest FROM g GROUP BY 1",
    "sparse_binning": f"WITH {PEAKS}, g AS (SELECT spectrum_id, floor(m - 100)::BIGINT AS bin, sum(i) AS i FROM pk GROUP BY ALL) SELECT bin, count(*) AS spectra, round(sum(i), 2) AS total FROM g GROUP BY 1",
    "precursor_peaks_removed": f"""WITH {PEAKS}, z AS (SELECT spectrum_id, pos, m, greatest(coalesce(precursor_charge, 1), 1) AS z, (precursor_mz - 1.00728::DOUBLE) * greatest(coalesce(precursor_charge, 1), 1) AS mass FROM pk WHERE precursor_mz IS NOT NULL),
h AS (SELECT DISTINCT spectrum_id, pos FROM z, range(1, 10) k(c), range(0, 2) j(o) WHERE c <= z AND abs(m - ((mass + o * 1.00335::DOUBLE) / c + 1.00728::DOUBLE)) <= 0.5),
g AS (SELECT spectrum_id, count(*) AS n FROM h GROUP BY 1)
SELECT spectrum_id, coalesce(n, 0)::INT AS removed FROM spec LEFT JOIN g USING (spectrum_id)""",
    "spectrum_names": f"""WITH {SPECTRA} SELECT spectrum_id, regexp_extract(title, '^([A-Za-z0-9]+)', 1) || '#S' || CASE WHEN length(regexp_extract(title, 'index:(\\d+)', 1)) < 4 THEN lpad(regexp_extract(title, 'index:(\\d+)', 1), 4, '0') ELSE regexp_extract(title, 'index:(\\d+)', 1) END AS name,
  concat_ws(':', 'mzspec', 'PXD000001', run_id, 'scan', scan) AS usi FROM spec""",
    "peptide_labels": "SELECT replace(peptide, 'L', 'I') || '/' || charge AS label, count(*) AS n, max(CASE WHEN charge IS NOT NULL THEN charge END)::INT AS charge FROM library_spectra GROUP BY 1",
    "hv_signs": f"""WITH {_BITS} SELECT vec_id, list_sum(list_transform(range(0, 62), lambda i: b[i + 1]::BIGINT << i))::BIGINT AS packed,
  list_sum(list_transform(range(0, 32), lambda i: b[i + 1]::BIGINT << (31 - i)))::BIGINT AS word0, list_sum(list_transform(range(0, 32), lambda i: b[i + 33]::BIGINT << (31 - i)))::BIGINT AS word1, list_sum(b)::BIGINT AS ones FROM bits""",
    "hv_distance_to_next": f"""WITH {_BITS}, p AS (SELECT a.vec_id, list_sum(list_transform(range(1, 65), lambda i: abs(a.b[i] - c.b[i])))::BIGINT AS d FROM bits a JOIN bits c ON c.vec_id = a.vec_id + 1) SELECT vec_id, d AS by_words, d AS by_dot FROM p""",
    "hv_encoded": f"""WITH {SPECTRA}, e AS (SELECT coalesce(list_max(intensity), 0) <= 0 AS none, coalesce(len(list_filter(mz, lambda m: m >= 0 AND m < 2000)), 0) = 0 AS out_of_range FROM spec)
SELECT style, count(*) AS vectors, count(*) FILTER (none OR (out_of_range AND style <> 'bipolar')) AS empty FROM e, (VALUES ('weighted'), ('bipolar'), ('aligned')) s(style) GROUP BY style""",
    "hv_top_k": f"""WITH {SPECTRA}, v AS (SELECT spectrum_id, packed_hv::BIT AS b FROM spec WHERE octet_length(packed_hv) = 256), p AS (SELECT q.spectrum_id AS query, r.spectrum_id AS item, (2048 - bit_count(xor(q.b, r.b)))::INT AS similarity FROM v q, v r WHERE q.spectrum_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS place FROM p) SELECT query, item, similarity, place::INT AS place FROM k WHERE place <= 10""",
}

"""Queries on search hits: candidates, best hits, error control and the cascade."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions import bits, scalars
from helixlake.operators import bandjoin, hypervectors, metrics, ordered, search
from helixlake.plans.lineage import materialise
from helixlake.plans.spectra import SPECTRA, spectra
from helixlake.sources.metrics import read_search_output
from helixlake.sources.tables import table


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a pair and stage: highest score; valid rows only."""
    h = table(spark, sf_dir, "search_hits").where("query_spectrum IS NOT NULL AND library_spectrum >= 0 AND score >= 0 AND NOT isnan(score)")
    return h.groupBy("query_spectrum", "library_spectrum", F.lower("stage").alias("stage")).agg(F.max("score").alias("score"))


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their library row; hits without one, or without a peptide, are dropped."""
    lib = table(spark, sf_dir, "library_spectra").where("peptide IS NOT NULL").withColumnRenamed("precursor_mz", "library_mz")
    return hits(spark, sf_dir).join(lib, F.col("library_spectrum") == F.col("library_id")).drop("library_id")


def best_identified(spark: SparkSession, sf_dir: str, stage: str) -> DataFrame:
    return search.best_hits(identified(spark, sf_dir).where(F.col("stage") == stage), "query_spectrum", "library_spectrum", "score").select("query_spectrum", "library_spectrum", "score", "is_decoy", "charge", "library_mz", "peptide")


HITS = """hit AS (SELECT query_spectrum, library_spectrum, lower(stage) AS stage, max(score) AS score FROM search_hits
  WHERE query_spectrum IS NOT NULL AND library_spectrum >= 0 AND score >= 0 AND NOT isnan(score) GROUP BY ALL)"""
IDENT = HITS + """, ident AS (SELECT h.*, l.peptide, l.charge, l.precursor_mz AS library_mz, l.is_decoy FROM hit h JOIN library_spectra l ON l.library_id = h.library_spectrum WHERE l.peptide IS NOT NULL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stage, query_spectrum ORDER BY score DESC, library_spectrum) AS r FROM ident) WHERE r = 1)"""


def _fdr_sql(name: str, rows: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""{name}_f AS (SELECT *, sum(CASE WHEN is_decoy THEN 1 ELSE 0 END) OVER ({part} ORDER BY score DESC RANGE UNBOUNDED PRECEDING)::DOUBLE
    / greatest(sum(CASE WHEN is_decoy THEN 0 ELSE 1 END) OVER ({part} ORDER BY score DESC RANGE UNBOUNDED PRECEDING), 1) AS f FROM {rows}),
{name} AS (SELECT *, min(f) OVER ({part} ORDER BY score RANGE UNBOUNDED PRECEDING) AS q FROM {name}_f)"""


def search_best_hits(spark, d):
    return best_identified(spark, d, "open").select("query_spectrum", "library_spectrum", "score", "peptide", "is_decoy")


def search_margins(spark, d):
    c = search.calibrated(hits(spark, d).where("stage = 'open'"), "query_spectrum", "library_spectrum", "score", 1)
    r = lambda n: F.round(n, 4).alias(n)
    return c.select("query_spectrum", "library_spectrum", "score", "candidates", r("runner_up"), r("margin"), r("normalized"), F.when(F.col("candidates") > 1, F.round("mean", 6)).alias("mean"))


def group_max_ties(spark, d):
    return search.group_max_with_ties(hits(spark, d), ["query_spectrum"], "score").select("query_spectrum", "library_spectrum", "stage", "score")


def score_summary(spark, d):
    s = search.score_summary(identified(spark, d), ["is_decoy"], "score")
    return s.select("is_decoy", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "largest")))


def candidate_summary(spark, d):
    per = hits(spark, d).groupBy("query_spectrum").agg(F.count(F.lit(1)).alias("c"))
    return search.count_summary(per, "c").withColumn("mean", F.round("mean", 6))


def fdr_qvalues(spark, d):
    q = search.q_values(best_identified(spark, d, "standard"), "score", "is_decoy")
    return q.select("query_spectrum", "library_spectrum", "score", F.round("q", 9).alias("q"))


def fdr_by_charge(spark, d):
    q = search.accepted(best_identified(spark, d, "open"), "score", "is_decoy", 0.1, ["charge"])
    return q.groupBy("charge").agg(F.count(F.lit(1)).alias("accepted"), F.round(F.min("score"), 6).alias("lowest"))


def search_cascade(spark, d):
    c = search.cascade(best_identified(spark, d, "standard"), best_identified(spark, d, "open"), "query_spectrum", "score", "is_decoy", 0.05)
    return c.select("stage", "query_spectrum", "library_spectrum", "score")


def _with_mass(spark, d, stage):
    s = spectra(spark, d).select(F.col("spectrum_id").alias("query_spectrum"), "precursor_mz")
    j = best_identified(spark, d, stage).join(s, "query_spectrum").where("precursor_mz > 0")
    return j.withColumn("mass_diff", search.mass_difference(F.col("precursor_mz"), F.col("library_mz"), F.col("charge")))


def mass_differences(spark, d):
    return _with_mass(spark, d, "open").select("query_spectrum", "library_spectrum", F.round("mass_diff", 6).alias("mass_diff"))


def grouped_cascade(spark, d):
    """The cascade with an error rate of its own for every common mass difference."""
    opened = _with_mass(spark, d, "open")
    groups = search.mass_groups(opened, "query_spectrum", "score", "mass_diff", 0.1, 20)
    c = search.cascade(best_identified(spark, d, "standard"), groups, "query_spectrum", "score", "is_decoy", 0.05, "mass_group")
    return c.select("stage", "query_spectrum", "library_spectrum", "score", "mass_group")


def stage_counts(spark, d):
    return search_cascade(spark, d).groupBy("stage").agg(F.count(F.lit(1)).alias("accepted"))


def engine_counts(spark, d):
    """Accepted hits by instrument of the query's run, beside all queries there."""
    runs = table(spark, d, "ms_runs").select("run_id", F.lower("instrument").alias("instrument"))
    s = spectra(spark, d).select("spectrum_id", "run_id").join(F.broadcast(runs), "run_id")
    acc = search_cascade(spark, d).select(F.col("query_spectrum").alias("spectrum_id"), "stage")
    j = s.join(acc, "spectrum_id", "left")
    return j.groupBy("instrument").agg(F.count(F.lit(1)).alias("spectra"), F.sum(F.when(F.col("stage") == "standard", 1).otherwise(0)).alias("standard"), F.sum(F.when(F.col("stage") == "open", 1).otherwise(0)).alias("open"))


def retry_queries(spark, d):
    first = search.accepted(best_identified(spark, d, "standard"), "score", "is_decoy", 0.05)
    return ordered.not_done(hits(spark, d).select("query_spectrum").distinct(), first, ["query_spectrum"])


def _band(spark, d, tolerance, width):
    s = spectra(spark, d).select("spectrum_id", F.col("precursor_charge").alias("charge"), F.col("precursor_mz").alias("query_mz")).where("query_mz > 0")
    lib = table(spark, d, "library_spectra").select("library_id", "charge", F.col("precursor_mz").alias("library_mz"))
    return bandjoin.band_join(s, lib, "query_mz", "library_mz", tolerance, width, ["charge"])


def band_join_abs(spark, d):
    return _band(spark, d, F.lit(0.05), 0.1).select("spectrum_id", "library_id")


def band_join_ppm(spark, d):
    return _band(spark, d, F.col("query_mz") * 20e-6, 0.05).groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("candidates"), F.min("library_id").alias("first_id"))


def merged_candidates(spark, d):
    """Candidates within 0.5 m/z of every spectrum, for its charge and one more, unknown charges tried as 2 and as 3; one that several charges give counts once."""
    s = scalars.charge_rows(spectra(spark, d).where("precursor_mz > 0"), "precursor_charge").select("spectrum_id", F.col("precursor_charge").alias("charge"), F.col("precursor_mz").alias("query_mz"))
    near = s.select("spectrum_id", F.explode(F.array(F.col("charge"), F.col("charge") + 1)).alias("charge"), "query_mz")
    lib = table(spark, d, "library_spectra").select("library_id", "charge", F.col("precursor_mz").alias("library_mz"))
    found = bandjoin.band_join(near, lib, "query_mz", "library_mz", F.lit(0.5), 1.0, ["charge"]).select("spectrum_id", "library_id").distinct()
    return found.groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("candidates"))


def file_cascade(spark, standard: str, opened: str, library: DataFrame, fdr: float):
    """The cascade over search output in files: the rows of the highest score of each query (then the first library id), joined
    to the library's (library_id, is_decoy); rows without a library hit are left out."""

    def best(path):
        rows = read_search_output(spark, path).where("library_id >= 0 AND score IS NOT NULL").select(F.col("query_idx").alias("query"), F.col("library_id").alias("item"), "score")
        top = search.group_max_with_ties(rows.distinct(), ["query"], "score")
        return search.best_hits(top, "query", "item", "score").join(library.select(F.col("library_id").alias("item"), "is_decoy"), "item")

    return search.cascade(best(standard), best(opened), "query", "score", "is_decoy", fdr).select("stage", "query", "item", "score")


def open_candidates(spark, d):
    """Candidates within 500 Da of every spectrum whose id is divisible by 50; unknown charges meet the whole library."""
    s = spectra(spark, d).where("spectrum_id % 50 = 0 AND precursor_mz > 0").select("spectrum_id", "precursor_charge", F.col("precursor_mz").alias("query_mz"))
    lib = table(spark, d, "library_spectra").select("library_id", "charge", F.col("precursor_mz").alias("library_mz"))
    j = bandjoin.open_band_join(s, lib, "query_mz", "library_mz", "precursor_charge", "charge", F.lit(500.0), 500.0)
    return j.groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("charge").alias("charges"))


THRESHOLDS, SEGMENTS = (1100, 1300, 1500, 1700), (4, 8, 16)


def _vector_pairs(spark, d):
    """Candidates (equal charge, within 2 Da) of every spectrum whose id is divisible by 50, with the words of both vectors."""
    s = spectra(spark, d).where(F.length("packed_hv") == 256).where("precursor_mz > 0 AND precursor_charge IS NOT NULL")
    s = s.select("spectrum_id", F.col("precursor_charge").alias("charge"), "precursor_mz", bits.words(F.col("packed_hv"), 256).alias("w"))
    q = s.where("spectrum_id % 50 = 0").select(F.col("spectrum_id").alias("query"), "charge", F.col("precursor_mz").alias("query_mz"), F.col("w").alias("qw"))
    return bandjoin.band_join(q, s.withColumnRenamed("spectrum_id", "item"), "query_mz", "precursor_mz", F.lit(2.0), 4.0, ["charge"])


def _sweep(spark, d):
    """Whole and partial similarities of those pairs."""
    p = _vector_pairs(spark, d)
    sim = lambda n: F.lit(56 * n) - bits.hamming_words(F.slice("qw", 1, n), F.slice("w", 1, n))
    return p.select("query", "item", (F.lit(2048) - bits.hamming_words(F.col("qw"), F.col("w"))).alias("similarity"), *(sim(n).alias(f"partial_{n}") for n in SEGMENTS))


def coarse_filter_sweep(spark, d):
    """Survivors and kept top-8 hits for every threshold and number of examined segments of 56 bits."""
    pairs = materialise(_sweep(spark, d), "sweep")
    exact = metrics.placed(pairs, ["query"], [F.desc("similarity"), F.col("item")]).where("place <= 8")
    long = pairs.select("query", "item", F.explode(F.array(*(F.struct(F.lit(n).alias("segments"), F.col(f"partial_{n}").alias("partial")) for n in SEGMENTS))).alias("p")).select("query", "item", "p.*")
    grid = long.withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    kept = hypervectors.coarse_filter(grid.withColumn("open_bits", 2048 - F.col("segments") * 56), "partial", 0, 0, F.col("threshold") - F.col("open_bits"))
    top = kept.join(exact.select("query", "item", "place"), ["query", "item"], "left")
    g = top.groupBy("segments", "threshold").agg(F.count(F.lit(1)).alias("surviving"), F.sum(F.when(F.col("place").isNotNull(), 1).otherwise(0)).alias("retained"), F.sum(F.when(F.col("place") == 1, 1).otherwise(0)).alias("first_retained"))
    total = pairs.agg(F.count(F.lit(1)).alias("unfiltered")).join(F.broadcast(exact.agg(F.count(F.lit(1)).alias("exact"))))
    out = g.join(F.broadcast(total))
    return out.select("segments", "threshold", "unfiltered", "surviving", "exact", "retained", "first_retained", F.round(hypervectors.candidate_reduction(F.col("unfiltered"), F.col("surviving")), 6).alias("reduction"), F.round(F.col("retained") / F.col("exact"), 6).alias("recall"))


def top_recall(spark, d):
    """What the filter of 16 segments and threshold 1,500 keeps of every query's 8 best."""
    pairs = materialise(_sweep(spark, d), "sweep")
    exact = metrics.placed(pairs, ["query"], [F.desc("similarity"), F.col("item")]).where("place <= 8")
    r = metrics.recall_of_top(exact, hypervectors.coarse_filter(pairs, "partial_16", 16 * 56, 2048, F.lit(1500)), "query", "item", 8)
    return r.select("exact", "retained", *(F.round(c, 6).alias(c) for c in ("full_query_recall", "top1_recall", "mean_retained")))


def sweep_choice(spark, d):
    return ordered.best_setting(coarse_filter_sweep(spark, d).select("segments", "threshold", "reduction", "recall").where("segments = 16"), "recall", "reduction", 0.99)


def sweep_deltas(spark, d):
    s = coarse_filter_sweep(spark, d).where("segments = 16").select("threshold", "reduction", "recall")
    return ordered.consecutive_deltas(s, ["threshold"], "reduction", "recall").withColumn("marginal", F.round("marginal", 4))


def _calibration(spark, d):
    """The 8th best similarity of the first fifth of the queries that have one."""
    eighth = metrics.placed(_sweep(spark, d), ["query"], [F.desc("similarity"), F.col("item")]).where("place = 8")
    return ordered.first_share(eighth, [F.col("query")], 0.2)


def sweep_thresholds(spark, d):
    return ordered.thresholds(_calibration(spark, d), "similarity", [1, 10, 25, 50, 75, 90, 95, 99])


def coarse_filtered_hits(spark, d):
    """Candidates that reach the calibrated threshold (1st percentile); the rest of a vector is compared only where its first
    segments leave that possible."""
    least = ordered.thresholds(_calibration(spark, d), "similarity", [1])
    pairs = _vector_pairs(spark, d).join(F.broadcast(least))
    return hypervectors.filtered_similarity(pairs, F.col("qw"), F.col("w"), 16, 56, 2048, F.col("threshold")).where("similarity >= threshold").select("query", "item", F.col("similarity").cast("long").alias("similarity"))


def vector_search(spark, d):
    """The standard stage from vectors: every spectrum whose id is divisible by 50 against the others of equal charge within 500
    ppm, best similarity, error control over odd ids as decoys."""
    s = spectra(spark, d).where(F.length("packed_hv") == 256).where("precursor_mz > 0 AND precursor_charge IS NOT NULL")
    s = s.select("spectrum_id", F.col("precursor_charge").alias("charge"), "precursor_mz", bits.words(F.col("packed_hv"), 256).alias("w"))
    q = s.where("spectrum_id % 50 = 0").select(F.col("spectrum_id").alias("query"), "charge", F.col("precursor_mz").alias("query_mz"), F.col("w").alias("qw"))
    lib = s.where("spectrum_id % 50 <> 0").select(F.col("spectrum_id").alias("item"), "charge", "precursor_mz", "w", (F.col("spectrum_id") % 2 == 1).alias("is_decoy"))
    return search.standard_stage(q, lib, F.col("query_mz") * 500e-6, 1.0, 2048).select("query", "item", F.col("similarity").cast("long").alias("similarity"), "is_decoy", F.round("q", 9).alias("q"))


def open_stage_membership(spark, d):
    """Every query of the standard stage and whether it goes on to the open stage."""
    best = best_identified(spark, d, "standard")
    first = search.accepted(best, "score", "is_decoy", 0.05).select("query_spectrum", F.lit(True).alias("done"))
    return best.select("query_spectrum").join(first, "query_spectrum", "left").select("query_spectrum", F.col("done").isNull().alias("open"))


QUERIES = {f.__name__: f for f in (search_best_hits, search_margins, group_max_ties, score_summary, candidate_summary, fdr_qvalues, fdr_by_charge, search_cascade, mass_differences, grouped_cascade, stage_counts, engine_counts, retry_queries, band_join_abs, band_join_ppm, open_candidates, coarse_filter_sweep, top_recall, merged_candidates, sweep_choice, sweep_deltas, sweep_thresholds, coarse_filtered_hits, vector_search, open_stage_membership)}

_STD = IDENT + ", std AS (SELECT * FROM best WHERE stage = 'standard'), opn AS (SELECT * FROM best WHERE stage = 'open'), " + _fdr_sql("sq", "std")
_CASCADE = _STD + ", acc AS (SELECT * FROM sq WHERE NOT is_decoy AND q <= 0.05), rest AS (SELECT * FROM opn WHERE query_spectrum NOT IN (SELECT query_spectrum FROM acc)), " + _fdr_sql("oq", "rest") + """,
casc AS (SELECT 'standard' AS stage, query_spectrum, library_spectrum, score FROM acc UNION ALL SELECT 'open', query_spectrum, library_spectrum, score FROM oq WHERE NOT is_decoy AND q <= 0.05)"""
_LIB = SPECTRA + ", q AS (SELECT * FROM spec WHERE precursor_mz > 0)"
_HEX = lambda n: f"from_hex(substr(hex(packed_hv), 1, {14 * n}))::BIT"
_SWEEP = SPECTRA + f""", v AS (SELECT spectrum_id, precursor_charge AS charge, precursor_mz AS mz, packed_hv::BIT AS b, {', '.join(f'{_HEX(n)} AS b{n}' for n in SEGMENTS)} FROM spec WHERE octet_length(packed_hv) = 256 AND precursor_mz > 0 AND precursor_charge IS NOT NULL),
pairs AS (SELECT q.spectrum_id AS query, r.spectrum_id AS item, 2048 - bit_count(xor(q.b, r.b)) AS similarity, {', '.join(f'{56 * n} - bit_count(xor(q.b{n}, r.b{n})) AS partial_{n}' for n in SEGMENTS)}
  FROM v q JOIN v r ON q.charge = r.charge AND r.mz BETWEEN q.mz - 2 AND q.mz + 2 WHERE q.spectrum_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS place FROM pairs),
grid AS (SELECT *, t.threshold FROM (UNPIVOT ranked ON {', '.join(f'partial_{n}' for n in SEGMENTS)} INTO NAME seg VALUE partial), (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]) AS threshold) t),
g AS (SELECT replace(seg, 'partial_', '')::INT AS segments, threshold::INT AS threshold, count(*) AS surviving, sum(CASE WHEN place <= 8 THEN 1 ELSE 0 END)::BIGINT AS retained, sum(CASE WHEN place = 1 THEN 1 ELSE 0 END)::BIGINT AS first_retained
  FROM grid WHERE partial + 2048 - 56 * replace(seg, 'partial_', '')::INT >= threshold GROUP BY ALL),
sweep AS (SELECT segments, threshold, (SELECT count(*) FROM pairs) AS unfiltered, surviving, (SELECT count(*) FROM ranked WHERE place <= 8) AS exact, retained, first_retained,
  round(1 - surviving::DOUBLE / (SELECT count(*) FROM pairs), 6) AS reduction, round(retained::DOUBLE / (SELECT count(*) FROM ranked WHERE place <= 8), 6) AS recall FROM g)"""
_FIFTH = "eighth AS (SELECT query, similarity, row_number() OVER (ORDER BY query) AS i, count(*) OVER () AS n FROM ranked WHERE place = 8), fifth AS (SELECT * FROM eighth WHERE i <= greatest(1, floor(n * 0.2::DOUBLE)))"
SQL = {
    "search_best_hits": f"WITH {IDENT} SELECT query_spectrum, library_spectrum, score, peptide, is_decoy FROM best WHERE stage = 'open'",
    "search_margins": f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_spectrum ORDER BY score DESC, library_spectrum) AS r FROM hit WHERE stage = 'open')
SELECT query_spectrum, max(CASE WHEN r = 1 THEN library_spectrum END) AS library_spectrum, max(score) AS score, count(*) AS candidates, round(coalesce(max(CASE WHEN r = 2 THEN score END), max(score)), 4) AS runner_up,
  round(max(score) - coalesce(max(CASE WHEN r = 2 THEN score END), max(score)), 4) AS margin, round(1 - 2 * (1 - max(score)), 4) AS normalized, CASE WHEN count(*) > 1 THEN round(avg(score), 6) END AS mean FROM r GROUP BY 1""",
    "group_max_ties": f"WITH {HITS} SELECT query_spectrum, library_spectrum, stage, score FROM hit QUALIFY score = max(score) OVER (PARTITION BY query_spectrum)",
    "score_summary": f"WITH {IDENT} SELECT is_decoy, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(quantile_cont(score, 0.95), 6) AS p95, round(max(score), 6) AS largest FROM ident GROUP BY 1",
    "candidate_summary": f"""WITH {HITS}, c AS (SELECT count(*) AS c FROM hit GROUP BY query_spectrum), r AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS n FROM c)
SELECT count(*) AS n, round(avg(c), 6) AS mean, max(CASE WHEN i = floor(0.95 * (n - 1)) THEN c END) AS p95, max(c) AS largest, sum(c)::BIGINT AS total FROM r""",
    "fdr_qvalues": f"WITH {_STD} SELECT query_spectrum, library_spectrum, score, round(q, 9) AS q FROM sq",
    "fdr_by_charge": f"WITH {IDENT}, opn AS (SELECT * FROM best WHERE stage = 'open'), {_fdr_sql('oq', 'opn', 'charge')} SELECT charge, count(*) AS accepted, round(min(score), 6) AS lowest FROM oq WHERE NOT is_decoy AND q <= 0.1 GROUP BY 1",
    "search_cascade": f"WITH {_CASCADE} SELECT stage, query_spectrum, library_spectrum, score FROM casc",
    "mass_differences": f"WITH {IDENT}, {SPECTRA} SELECT query_spectrum, library_spectrum, round((precursor_mz - library_mz) * charge, 6) AS mass_diff FROM best JOIN spec ON spectrum_id = query_spectrum WHERE stage = 'open' AND precursor_mz > 0",
    "stage_counts": f"WITH {_CASCADE} SELECT stage, count(*) AS accepted FROM casc GROUP BY 1",
    "engine_counts": f"""WITH {_CASCADE}, {SPECTRA} SELECT lower(instrument) AS instrument, count(*) AS spectra, sum(CASE WHEN casc.stage = 'standard' THEN 1 ELSE 0 END)::BIGINT AS standard, sum(CASE WHEN casc.stage = 'open' THEN 1 ELSE 0 END)::BIGINT AS open
FROM spec JOIN ms_runs USING (run_id) LEFT JOIN casc ON query_spectrum = spectrum_id GROUP BY 1""",
    "retry_queries": f"WITH {_CASCADE} SELECT DISTINCT query_spectrum FROM hit WHERE query_spectrum NOT IN (SELECT query_spectrum FROM acc)",
    "band_join_abs": f"WITH {_LIB} SELECT spectrum_id, library_id FROM q JOIN library_spectra l ON l.charge = q.precursor_charge AND l.precursor_mz BETWEEN q.precursor_mz - 0.05::DOUBLE AND q.precursor_mz + 0.05::DOUBLE",
    "band_join_ppm": f"WITH {_LIB} SELECT spectrum_id, count(*) AS candidates, min(library_id) AS first_id FROM q JOIN library_spectra l ON l.charge = q.precursor_charge AND l.precursor_mz BETWEEN q.precursor_mz - q.precursor_mz * 20e-6::DOUBLE AND q.precursor_mz + q.precursor_mz * 20e-6::DOUBLE GROUP BY 1",
    "open_candidates": f"""WITH {_LIB} SELECT spectrum_id, count(*) AS candidates, count(DISTINCT l.charge) AS charges FROM q JOIN library_spectra l ON l.precursor_mz BETWEEN q.precursor_mz - 500 AND q.precursor_mz + 500
  AND (l.charge = q.precursor_charge OR (q.precursor_charge IS NULL OR q.precursor_charge NOT IN (SELECT DISTINCT charge FROM library_spectra WHERE charge IS NOT NULL))) WHERE spectrum_id % 50 = 0 GROUP BY 1""",
    "coarse_filter_sweep": f"WITH {_SWEEP} SELECT * FROM sweep",
    "sweep_choice": f"""WITH {_SWEEP} SELECT segments, threshold, reduction, recall FROM sweep WHERE segments = 16
ORDER BY recall >= 0.99 DESC, CASE WHEN recall >= 0.99 THEN reduction ELSE recall END DESC, CASE WHEN recall >= 0.99 THEN recall ELSE reduction END DESC, segments DESC, threshold DESC LIMIT 1""",
    "sweep_deltas": f"""WITH {_SWEEP}, w AS (SELECT threshold, reduction, recall, reduction - lag(reduction) OVER (ORDER BY threshold) AS g, lag(recall) OVER (ORDER BY threshold) - recall AS x FROM sweep WHERE segments = 16)
SELECT threshold, reduction, recall, CASE WHEN g > 0 THEN round(x / g, 4) END AS marginal FROM w""",
    "sweep_thresholds": f"""WITH {_SWEEP}, {_FIFTH} SELECT DISTINCT floor(t)::BIGINT AS threshold FROM (SELECT unnest(quantile_cont(similarity::DOUBLE, [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])) AS t FROM fifth) WHERE t IS NOT NULL""",
    "top_recall": f"""WITH {_SWEEP}, k AS (SELECT query, count(*) AS n, count(*) FILTER (partial_16 + 2048 - 896 >= 1500) AS kept, max(CASE WHEN place = 1 THEN (partial_16 + 2048 - 896 >= 1500)::INT END) AS first FROM ranked WHERE place <= 8 GROUP BY 1)
SELECT sum(n)::BIGINT AS exact, sum(kept)::BIGINT AS retained, round(avg((kept = n)::INT), 6) AS full_query_recall, round(avg(first), 6) AS top1_recall, round(avg(kept), 6) AS mean_retained FROM k""",
    "merged_candidates": f"""WITH {_LIB}, x AS (SELECT spectrum_id, precursor_mz, unnest(CASE WHEN precursor_charge IS NULL THEN [2, 3, 4] ELSE [precursor_charge, precursor_charge + 1] END) AS z FROM q)
SELECT spectrum_id, count(DISTINCT library_id) AS candidates FROM x JOIN library_spectra l ON l.charge = z AND l.precursor_mz BETWEEN x.precursor_mz - 0.5::DOUBLE AND x.precursor_mz + 0.5::DOUBLE GROUP BY 1""",
    "coarse_filtered_hits": f"""WITH {_SWEEP}, {_FIFTH} SELECT query, item, similarity::BIGINT AS similarity FROM pairs WHERE similarity >= (SELECT floor(quantile_cont(similarity::DOUBLE, 0.01)) FROM fifth)""",
    "vector_search": f"""WITH {_SWEEP}, c AS (SELECT q.spectrum_id AS query, r.spectrum_id AS item, 2048 - bit_count(xor(q.b, r.b)) AS score FROM v q JOIN v r ON q.charge = r.charge AND r.mz BETWEEN q.mz - q.mz * 500e-6::DOUBLE AND q.mz + q.mz * 500e-6::DOUBLE WHERE q.spectrum_id % 50 = 0 AND r.spectrum_id % 50 <> 0),
h AS (SELECT DISTINCT ON (query) query, item, score, item % 2 = 1 AS is_decoy FROM c ORDER BY query, score DESC, item), {_fdr_sql("x", "h")} SELECT query, item, score::BIGINT AS similarity, is_decoy, round(q, 9) AS q FROM x""",
    "open_stage_membership": f"WITH {_CASCADE} SELECT query_spectrum, query_spectrum NOT IN (SELECT query_spectrum FROM acc) AS open FROM std",
}

"""Queries p1 to p8 (without p4, which is in the core) over the project's tables, and SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm.chunks import split_points
from helixlake.llm.clusters import density_clusters
from helixlake.llm.encoding import repair_encoding
from helixlake.llm.leaks import find_leaks
from helixlake.llm.neighbours import nearest_neighbours, neighbour_pairs
from helixlake.llm.packing import pack_texts
from helixlake.llm.topn import top_n
from helixlake.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_neighbours(table(spark, sf_dir, "encoded_spectra"), "spectrum_id", "packed_hv", k=10, max_distance=700)
    return neighbour_pairs(near).select(F.col("a").alias("spectrum_a"), F.col("b").alias("spectrum_b"))


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spectrum whose most similar one differs in at most 100 bits, with that number: there nothing may be lost."""
    near = nearest_neighbours(table(spark, sf_dir, "encoded_spectra"), "spectrum_id", "packed_hv", k=10, max_distance=700)
    return near.groupBy(F.col("id").alias("spectrum_id")).agg(F.min("distance").cast("long").alias("distance")).where("distance <= 100")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    spectra = table(spark, sf_dir, "encoded_spectra")
    return density_clusters(spectra, "spectrum_id", "packed_hv", "spectrum.precursor_charge", "spectrum.precursor_mz")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clusters(spark, sf_dir).where("id <> medoid")
    return rows.select(F.least("id", "medoid").alias("spectrum_a"), F.greatest("id", "medoid").alias("spectrum_b"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's size, medoid and most persistent members."""
    rows = _clusters(spark, sf_dir).groupBy("cluster", "size", "medoid")
    return rows.agg(F.array_sort(F.collect_list(F.when(F.col("exemplar"), F.col("id")))).alias("exemplars"))


def p2_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stable clusters inside the trees: cores of three, at least three members, divided down to 128 differing bits."""
    spectra = table(spark, sf_dir, "encoded_spectra")
    rows = density_clusters(spectra, "spectrum_id", "packed_hv", "spectrum.precursor_charge", "spectrum.precursor_mz", min_samples=3, min_size=3, epsilon=128)
    rows = rows.groupBy("cluster", "size", "medoid", "total_distance", F.round("stability", 6).alias("stability"))
    return rows.agg(F.array_sort(F.collect_list(F.when(F.col("exemplar"), F.col("id")))).alias("exemplars"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "graph_nodes")
    return split_points(nodes, "node_id", "seq", limit=2000, overlap=100, least=1000, gap="[Nn-]{10,}").withColumnRenamed("id", "node_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").where("library_spectrum >= 0 AND score >= 0")
    return top_n(hits, "query_spectrum", "library_spectrum", "score", 5).select("query_spectrum", "library_spectrum")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", capacity=2048)


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any good packing: texts placed, texts in no container, containers over capacity, and whether there are
    at most three more of them than would be filled to 98 %."""
    put = p6_packed(spark, sf_dir)
    texts = put.groupBy("doc_id").agg(F.count("container").alias("pieces"))
    texts = texts.agg(F.count(F.when(F.col("pieces") > 0, 1)).alias("placed"), F.count(F.when(F.col("pieces") == 0, 1)).alias("empty"))
    load = put.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    load = load.agg(F.count(F.when(F.col("n") > 2048, 1)).alias("over"), (F.sum("n") >= 0.98 * 2048 * (F.count(F.lit(1)) - 3)).alias("filled"))
    return texts.join(F.broadcast(load))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return find_leaks(docs, "doc_id", "text", items, "item_id", "text").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_encoding(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_restored(spark, sf_dir).select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_nearest": p1_nearest, "p2_found": p2_found, "p2_clusters": p2_clusters, "p2_stable": p2_stable, "p3_found": p3_found, "p5_found": p5_found, "p6_packed": p6_packed, "p6_checked": p6_checked, "p7_found": p7_found, "p8_found": p8_found, "p8_restored": p8_restored}
_USABLE = """usable AS (SELECT DISTINCT ON (spectrum_id) spectrum_id AS id, packed_hv::BIT AS b, spectrum.precursor_charge AS z, spectrum.precursor_mz AS mz FROM encoded_spectra
  WHERE octet_length(packed_hv) = 256 AND packed_hv <> from_hex(repeat('00', 256)) AND packed_hv <> from_hex(repeat('FF', 256)))"""
_CLUSTERS = f"""{_USABLE},
near AS (SELECT a.id AS i, c.id AS j FROM usable a JOIN usable c ON a.z = c.z AND c.mz BETWEEN a.mz - 2.0::DOUBLE AND a.mz + 2.0::DOUBLE AND a.id <> c.id WHERE a.mz > 0 AND c.mz > 0 AND bit_count(xor(a.b, c.b)) <= 512),
reach AS (SELECT i, j FROM near UNION SELECT r.i, n.j FROM reach r JOIN near n ON n.i = r.j),
member AS (SELECT i AS id, least(min(j), i) AS cluster FROM reach GROUP BY i),
total AS (SELECT m.id, m.cluster, sum(bit_count(xor(a.b, c.b))) AS t FROM member m JOIN member o USING (cluster) JOIN usable a ON a.id = m.id JOIN usable c ON c.id = o.id GROUP BY ALL),
typical AS (SELECT DISTINCT ON (cluster) cluster, id AS medoid FROM total ORDER BY cluster, t, id)"""
SQL: dict[str, str] = {
    "p1_nearest": f"WITH {_USABLE}, d AS (SELECT a.id AS spectrum_id, min(bit_count(xor(a.b, c.b)))::BIGINT AS distance FROM usable a JOIN usable c ON a.id <> c.id GROUP BY 1) SELECT * FROM d WHERE distance <= 100",
    "p2_found": f"WITH RECURSIVE {_CLUSTERS} SELECT least(id, medoid) AS spectrum_a, greatest(id, medoid) AS spectrum_b FROM member JOIN typical USING (cluster) WHERE id <> medoid",
    "p6_checked": "SELECT count(*) FILTER (length(text) > 0) AS placed, count(*) FILTER (text IS NULL OR length(text) = 0) AS empty, 0::BIGINT AS over, true AS filled FROM documents",
    "p5_found": """
SELECT query_spectrum, library_spectrum FROM (
  SELECT query_spectrum, library_spectrum, row_number() OVER (PARTITION BY query_spectrum ORDER BY s DESC, library_spectrum) AS place
  FROM (SELECT query_spectrum, library_spectrum, max(score) AS s FROM search_hits
        WHERE query_spectrum IS NOT NULL AND library_spectrum >= 0 AND score >= 0 AND NOT isnan(score) GROUP BY ALL))
WHERE place <= 5""",
    "p3_found": """
WITH RECURSIVE long AS (
  SELECT node_id, max(t) AS t FROM (SELECT node_id, regexp_replace(seq, '\\s', '', 'g') AS t FROM graph_nodes) WHERE length(t) > 2000 GROUP BY node_id),
marked AS (SELECT node_id, length(t) AS n, regexp_replace(t, '([Nn-]{10,})', '\\1|', 'g') AS m FROM long),
ends AS (
  SELECT node_id, n, list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))) AS e
  FROM (SELECT node_id, n, string_split(m, '|') AS p FROM marked)),
cut AS (
  SELECT node_id, n, e, 0::BIGINT AS s, CASE WHEN n <= 2000 THEN n ELSE coalesce(list_max(list_filter(e, lambda x: x > 1000 AND x <= 2000)), 2000) END::BIGINT AS f FROM ends
  UNION ALL
  SELECT node_id, n, e, f - 100, CASE WHEN n - (f - 100) <= 2000 THEN n ELSE coalesce(list_max(list_filter(e, lambda x: x > f + 900 AND x <= f + 1900)), f + 1900) END::BIGINT
  FROM cut WHERE f < n)
SELECT node_id, s AS piece_start, f AS piece_end FROM cut""",
}

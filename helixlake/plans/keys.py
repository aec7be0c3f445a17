"""Queries of the core over the project's tables, and the SQL they must agree with."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.operators.heavykeys import canonical_kmer, canonical_node, eager_join_sums, heavy_keys, key_counts, written_counts
from helixlake.sources.tables import table


FORMS = {"kmer": canonical_kmer, "node_id": canonical_node}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "minimizer_hits")
    counted = written_counts(hits, "hit_id", list(FORMS))
    total = counted.where("key_field IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return heavy_keys(key_counts(hits, "hit_id", FORMS, counted), total).select("key_field", "key_value")


def p4_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_counts(table(spark, sf_dir, "minimizer_hits"), "hit_id", FORMS)


def p4_anchor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every k-mer, the pairs of a hit and an out-edge of its node: a join that one hot node would blow up."""
    hits = table(spark, sf_dir, "minimizer_hits").groupBy("hit_id").agg(F.min("kmer").alias("k"), F.min("node_id").alias("v"))
    hits = hits.select(canonical_kmer(F.col("k")).alias("kmer"), canonical_node(F.col("v")).alias("node_id")).where("kmer IS NOT NULL AND node_id IS NOT NULL")
    nodes = table(spark, sf_dir, "graph_nodes").select(F.col("node_id"), F.explode("out_edges").alias("edge")).distinct()
    return eager_join_sums(hits, nodes, ["node_id"], ["kmer"])


_CANON = """
canon AS (
  SELECT hit_id, CASE WHEN regexp_full_match(k, '[ACGT]{15}') THEN least(k, reverse(translate(k, 'ACGT', 'TGCA'))) END AS kmer,
         CASE WHEN v NOT IN ('', '*') THEN v END AS node_id
  FROM (SELECT hit_id, upper(regexp_replace(min(kmer), '^\\s+|\\s+$', '', 'g')) AS k,
               regexp_replace(regexp_replace(min(node_id), '\\s', '', 'g'), '^[<>]+', '') AS v
        FROM minimizer_hits GROUP BY hit_id)),
counts AS (
  SELECT 'kmer' AS key_field, kmer AS key_value, count(*) AS n FROM canon WHERE kmer IS NOT NULL GROUP BY kmer
  UNION ALL SELECT 'node_id', node_id, count(*) FROM canon WHERE node_id IS NOT NULL GROUP BY node_id)"""

QUERIES = {"p4_found": p4_found, "p4_key_counts": p4_key_counts, "p4_anchor_counts": p4_anchor_counts}
SQL = {
    "p4_found": f"WITH {_CANON} SELECT key_field, key_value FROM counts WHERE n >= 0.02 * (SELECT count(DISTINCT hit_id) FROM minimizer_hits)",
    "p4_key_counts": f"WITH {_CANON} SELECT key_field, key_value, n FROM counts",
    "p4_anchor_counts": f"""WITH {_CANON}, edges AS (SELECT DISTINCT node_id, unnest(out_edges) AS edge FROM graph_nodes)
SELECT kmer, count(*) AS n FROM canon JOIN edges USING (node_id) WHERE kmer IS NOT NULL GROUP BY kmer""",
}

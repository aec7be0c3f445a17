"""Queries on run metrics, manifests, orders, samples, sets and cost models, over the relational tables."""

from functools import reduce

from pyspark.sql import functions as F

from helixlake.functions import scalars
from helixlake.operators import bandjoin, metrics, models, ordered, warehouse
from helixlake.plans.spectra import SIZES, _sizes
from helixlake.sources import sinks
from helixlake.sources.tables import table


def cold_warm_pairing(spark, d):
    """Clicks as cold runs, views as warm ones, by user: medians and the movement between them."""
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "click", "cold").when(F.col("event_type") == "view", "warm").alias("mode"), "value")
    m = warehouse.cold_warm_medians(e, ["user_id"], "mode", "value")
    return m.select("user_id", *(F.round(c, 6).alias(c) for c in m.columns[1:]))


def cold_warm_rows(spark, d):
    e = table(spark, d, "events")
    r = warehouse.cold_warm_rows(e.where("event_type = 'click'").select("event_id", "user_id", "value"), e.where("event_type = 'view'"), ["user_id"], "value")
    return r.select("event_id", *(F.round(c, 6).alias(c) for c in ("warm_time", "movement_time", "movement_fraction")))


def _spans(spark, d):
    s = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value", s.alias("s"), (s + (F.floor("value") * 1000000).cast("long")).alias("e"))


def interval_union(spark, d):
    return warehouse.union_length(_spans(spark, d), ["user_id"], "s", "e")


def interval_union_by_type(spark, d):
    """The same for a handful of hot groups: merged inside cells of a day first."""
    day = 86_400_000_000
    return warehouse.union_length(warehouse.premerge(_spans(spark, d), ["event_type"], "s", "e", float(day)), ["event_type"], "s", "e")


def interval_peak(spark, d):
    e = table(spark, d, "events")
    iv = e.where("event_type = 'click'").select("event_id", "user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 2 days")).alias("finish"))
    return bandjoin.max_within(iv, e.select("user_id", "ts", "value"), ["user_id"], "start", "finish", "ts", "value", "86400").select("event_id", "peak")


def direction_rollup(spark, d):
    kinds = spark.createDataFrame([("click", "HtoD"), ("view", "DtoH"), ("purchase", "DtoD")], "k string, l string")
    e = warehouse.labelled(table(spark, d, "events"), "event_type", kinds, "k", "l", "direction")
    r = warehouse.direction_rollup(e, "direction", "user_id", "value")
    return r.withColumn("time", F.round("time", 3))


def stage_rollup(spark, d):
    o = table(spark, d, "orders").withColumn("done", F.col("o_orderstatus") == "F")
    r = warehouse.stage_rollup(o, "o_orderpriority", "done", "o_custkey", "o_orderkey", "o_totalprice")
    return r.select("stage", "rows", "completed", "seconds", "bytes", "max_rss", F.round("throughput", 6).alias("throughput"), F.round("complete_percent", 6).alias("complete_percent"))


def list_column_totals(spark, d):
    l = table(spark, d, "lineitem").withColumn("both", F.concat_ws(";", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")))  # noqa: E741
    return warehouse.list_totals(l, "both")


def manifest_status(spark, d):
    docs = table(spark, d, "documents")
    found = docs.where("text IS NOT NULL").select("doc_id", F.length("text").alias("found"))
    return warehouse.manifest_status(docs.select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("size")), found, "doc_id", "size", "found").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def regression_metrics(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("t"), F.col("l_quantity").alias("p"))  # noqa: E741
    m = metrics.regression_metrics(l, "t", "p")
    return m.select("n", *(F.round(c, 6).alias(c) for c in ("mae", "mse", "rmse", "r2")))


def event_averages(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"))


def props_parsed(spark, d):
    """Numbers read out of JSON text; what isn't a number is null, a missing one 0."""
    v = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", scalars.number_or(v).alias("k"), scalars.number_or(F.get_json_object("props", "$.none"), F.lit(0.0)).alias("missing"))


def display_forms(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", scalars.humanised_seconds(F.pow(F.col("p_size"), 3) * 2.5).alias("time"), scalars.humanised_bytes(F.col("p_size") * 40000.0).alias("size"), scalars.natural_key(F.col("p_name")).alias("key"))


def mztab_rows(spark, d):
    """Library rows as lines of a report, with their chunk of 1,000 in natural order."""
    lib = table(spark, d, "library_spectra").where("peptide IS NOT NULL")
    rows = sinks.mztab_lines(lib, {}, ["library_id", "peptide", "charge"], "peptide").where("section = '3-PSM'")
    return sinks.chunk_ids(rows.select("value"), [F.col("value")], 1000)


def paf_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 500).alias("end"), (F.col("o_orderkey") % 200).alias("length"), (F.col("o_custkey") % 300).alias("score"))
    return sinks.paf_columns(o, "end", "length", "score")


def union_align(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return ordered.aligned_union({"customer": c, "supplier": s}, ["name", "balance", "region"])


def key_intersection(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return ordered.common_keys(a, table(spark, d, "customer").select(F.col("c_custkey").alias("k")), ["k"])


def resume_antijoin(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return ordered.not_done(table(spark, d, "customer"), done, ["c_custkey"]).select("c_custkey", "c_name")


def input_equivalence(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    turned = docs.where("doc_id % 2 = 0").union(docs.where("doc_id % 2 <> 0"))
    moved = turned.withColumn("doc_id", F.when(F.col("doc_id") <= 2, 3 - F.col("doc_id")).otherwise(F.col("doc_id")))
    kinds = {"multiset": ordered.equivalent_inputs(docs, moved, "text"), "ordered": ordered.equivalent_inputs(docs, turned, "text", "doc_id"), "moved": ordered.equivalent_inputs(docs, moved, "text", "doc_id")}
    return reduce(lambda a, b: a.unionByName(b), (df.withColumn("kind", F.lit(k)) for k, df in kinds.items()))


def source_digests(spark, d):
    return scalars.stream_digest(table(spark, d, "ms_runs").withColumn("i", F.lower("instrument")), ["i"], "run_id", "run_id")


def hash_sample_cutoff(spark, d):
    """Documents in hash order until a million characters are reached, the crossing one included."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    return ordered.until_total(docs, ordered.hash_order("doc_id"), "size", 1_000_000).select("doc_id", "before")


def prefix_cutoff(spark, d):
    """Texts in id order cut at 500,000 characters exactly."""
    docs = table(spark, d, "documents").where("length(text) >= 50").select("doc_id", "text")
    return ordered.truncated_to_total(docs, [F.col("doc_id")], "text", 500_000).select("doc_id", F.length("text").alias("kept"))


def seeded_sample(spark, d):
    return table(spark, d, "orders").orderBy(*ordered.hash_order("o_orderkey", seed="7")).limit(100).select("o_orderkey")


def candidate_caps(spark, d):
    """At most 3 orders a customer, by price then key."""
    p = metrics.placed(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])
    return p.where("place <= 3").select("o_custkey", "o_orderkey", "place")


def capped_groups(spark, d):
    """At most 20 parts a brand, brands by size, 100 parts in all."""
    return ordered.capped_groups(table(spark, d, "part"), "p_brand", [F.col("p_partkey")], 20, 100).select("p_brand", "p_partkey")


def round_robin(spark, d):
    return ordered.round_robin(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 16, 500)


def best_by_struct(spark, d):
    """The line of every order with most (quantity, price), then the first line."""
    l = table(spark, d, "lineitem")  # noqa: E741
    best = F.max(F.struct("l_quantity", "l_extendedprice", (-F.col("l_linenumber")).alias("n"))).alias("m")
    return l.groupBy("l_orderkey").agg(best).select("l_orderkey", "m.l_quantity", "m.l_extendedprice", (-F.col("m.n")).alias("l_linenumber"))


def group_pairs(spark, d):
    """Pairs of customers in one segment whose balances share a bucket of 5."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", bandjoin.bucket_key(F.col("c_acctbal"), 5.0).alias("b"))
    return bandjoin.bucket_pairs(c, "c_custkey", ["c_mktsegment", "b"]).select("c_custkey_a", "c_custkey_b")


def expert_routing(spark, d):
    """The first four dimensions as router logits: vectors and weight by their best expert, and of the second."""
    e = table(spark, d, "embeddings").select("vec_id", models.routed_experts(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")), 2).alias("r"))
    return e.groupBy(F.get("r", 0)["expert"].alias("expert")).agg(F.count(F.lit(1)).alias("vectors"), F.round(F.sum(F.get("r", 0)["weight"]), 4).alias("weight"), F.round(F.sum(F.get("r", 1)["weight"]), 4).alias("second_weight"))


A = models.Array()


def bucket_costs(spark, d):
    """Time and energy of clustering every bucket, against one array pass over all spectra."""
    b = _sizes(spark, d)
    cost = models.bucket(F.col("n"))
    t = b.select("n", *(c.alias(k) for k, c in cost.items())).agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in cost))
    whole, enc, flt, link = models.bucket(F.col("n")), models.encoding(F.col("n")), models.coarse_filter(F.col("n")), models.link_transfer(F.col("n"))
    r = lambda c, n: F.round(c * 1e6, 4).alias(n)
    return t.select("n", "passes", r(F.col("seconds"), "bucket_us"), r(F.col("energy_mj"), "bucket_nj"), r(F.col("restore_seconds"), "restore_us"), r(whole["seconds"], "whole_us"), F.round(whole["seconds"] / F.col("seconds"), 4).alias("speedup"), enc["batches"].alias("batches"), r(enc["seconds"], "encode_us"), r(flt["seconds"], "filter_us"), r(flt["energy_mj"], "filter_nj"), r(link["seconds"], "link_us"))


def search_costs(spark, d):
    per = table(spark, d, "search_hits").groupBy("query_spectrum").agg(F.count(F.lit(1)).alias("c"))
    c = models.search_cost(per, "c", columns=64)
    return c.select("queries", "comparisons", "restore_passes", "compare_bytes", *(F.round(F.col(k) * 1e6, 4).alias(k) for k in ("compare_seconds", "broadcast_seconds", "result_seconds", "restore_seconds", "restore_mj")))


def transfer_costs(spark, d):
    """Orders as transfers: bytes by key, bandwidth by status, warm where the priority says so."""
    gb = F.when(F.col("o_orderstatus") == "F", 256.0).when(F.col("o_orderstatus") == "O", 512.0).otherwise(2000.0)
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 1000).alias("size"), gb.alias("gbps"), F.col("o_orderpriority").startswith("1").alias("warm"))
    c = models.cold_warm_links(o, "size", "gbps", "warm", 2.4).select(F.col("cold_bytes"), F.round("cold_ms", 4).alias("cold_ms"), F.round("cold_mj", 4).alias("cold_mj"), F.col("warm_bytes").cast("long").alias("warm_bytes"), F.round("warm_ms", 4).alias("warm_ms"), F.round("warm_mj", 4).alias("warm_mj"))
    s = models.segments(o, "o_orderkey", "size", "gbps").select(F.round(F.col("seconds") * 1e3, 4).alias("segment_ms"))
    return c.join(F.broadcast(s))


def projections(spark, d):
    """Suppliers as measured phases: scaled, extrapolated, combined, with movement, power and lower bounds."""
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 1.5).alias("t"), (F.col("s_nationkey") * 10.0).alias("w"), F.when(F.col("s_suppkey") % 3 == 0, "compute").when(F.col("s_suppkey") % 3 == 1, "memory").otherwise("fixed").alias("bound"))
    m = models.movement(F.col("t"), F.col("w"), F.col("t"), F.col("w"))
    r = models.restore_rollup(F.col("s_suppkey"), F.col("s_suppkey"), F.lit(1.0))
    sc = models.scaled(F.col("t"), 2.0, 3.0, 1.0, 4.0, F.col("bound"))
    return s.select(
        "s_suppkey", F.round(sc, 6).alias("scaled"), F.round(models.extrapolated(F.col("t"), F.col("w"), F.lit(100.0)), 6).alias("extrapolated"), F.round(models.combined([F.col("t"), F.col("w"), sc], "overlap"), 6).alias("overlap"), F.round(models.combined([F.col("t"), F.col("w")], "additive"), 6).alias("additive"),
        F.round(m["movement"], 6).alias("movement"), F.round(m["reduction_percent"], 6).alias("reduction"), models.plausible_power(F.col("w"), 90.0).alias("power"), models.fastq_bytes(F.col("s_suppkey") * 100, F.col("s_suppkey")).alias("fastq"), models.all_pairs_cycles(F.col("s_suppkey")).alias("cycles"), F.round(r["energy_j"] * 1e6, 3).alias("energy_uj"),
    )


def total_latencies(spark, d):
    """The sum over stages is null when a stage is missing."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("stage")).agg(F.sum("o_custkey").cast("double").alias("s"))
    full, part = models.total_latency(o, "stage", "s", ["F", "O", "P"]), models.total_latency(o, "stage", "s", ["F", "X"])
    return full.unionByName(part).select("total_seconds", F.concat_ws(",", "missing").alias("missing"))


QUERIES = {f.__name__: f for f in (cold_warm_pairing, cold_warm_rows, interval_union, interval_union_by_type, interval_peak, direction_rollup, stage_rollup, list_column_totals, manifest_status, regression_metrics, event_averages, props_parsed, display_forms, mztab_rows, paf_rows, union_align, key_intersection, resume_antijoin, input_equivalence, source_digests, hash_sample_cutoff, prefix_cutoff, seeded_sample, candidate_caps, capped_groups, round_robin, best_by_struct, group_pairs, expert_routing, bucket_costs, search_costs, transfer_costs, projections, total_latencies)}

_SPAN = "sp AS (SELECT user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + floor(value)::BIGINT * 1000000 AS e FROM events WHERE value IS NOT NULL)"


def _union_sql(by):
    return f"""WITH {_SPAN}, x AS (SELECT {by}, s, greatest(s, e) AS e FROM sp), y AS (SELECT *, max(e) OVER (PARTITION BY {by} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x),
z AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM y), m AS (SELECT {by}, i, max(e) - min(s) AS len FROM z GROUP BY ALL)
SELECT {by}, sum(len)::BIGINT AS covered, count(*) AS islands FROM m GROUP BY 1"""


_ORD = "sha256('7|' || o_orderkey)"
SQL = {
    "cold_warm_pairing": """WITH m AS (SELECT user_id, median(value) FILTER (event_type = 'click') AS c, median(value) FILTER (event_type = 'view') AS w FROM events GROUP BY 1)
SELECT user_id, round(c, 6) AS cold_median, round(w, 6) AS warm_median, round(greatest(c - w, 0), 6) AS movement, CASE WHEN c > 0 THEN round(greatest(c - w, 0) / c, 6) END AS fraction FROM m WHERE c IS NOT NULL AND w IS NOT NULL""",
    "cold_warm_rows": """WITH w AS (SELECT user_id, avg(value) AS w FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT event_id, round(w, 6) AS warm_time, CASE WHEN w IS NULL THEN 0 ELSE round(greatest(value - w, 0), 6) END AS movement_time, CASE WHEN value > 0 THEN CASE WHEN w IS NULL THEN 0 ELSE round(greatest(value - w, 0) / value, 6) END END AS movement_fraction FROM events LEFT JOIN w USING (user_id) WHERE event_type = 'click'""",
    "interval_union": _union_sql("user_id"),
    "interval_union_by_type": _union_sql("event_type"),
    "interval_peak": "SELECT a.event_id, max(b.value) AS peak FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 DAY WHERE a.event_type = 'click' GROUP BY 1",
    "direction_rollup": """WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'HtoD' WHEN 'view' THEN 'DtoH' WHEN 'purchase' THEN 'DtoD' ELSE 'kind_' || event_type END AS direction, user_id, value FROM events)
SELECT direction, CASE WHEN lower(direction) LIKE '%htod%' THEN 'in' WHEN lower(direction) LIKE '%dtoh%' THEN 'out' ELSE 'other' END AS side, sum(user_id)::BIGINT AS bytes, count(*) AS copies, round(sum(value), 3) AS time FROM e GROUP BY ALL""",
    "stage_rollup": """SELECT o_orderpriority AS stage, count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS completed, sum(o_custkey)::BIGINT AS seconds, sum(o_orderkey)::BIGINT AS bytes, max(o_totalprice) AS max_rss, round(sum(o_orderkey)::DOUBLE / sum(o_custkey), 6) AS throughput,
  round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS complete_percent FROM orders GROUP BY 1""",
    "list_column_totals": "SELECT count(*) AS rows, sum(trunc(l_quantity) + l_linenumber)::BIGINT AS total, true AS all_listed, true AS any_listed FROM lineitem",
    "manifest_status": "SELECT CASE WHEN text IS NULL THEN 'missing' WHEN length(text) = coalesce(n_chars, 0) THEN 'complete' WHEN length(text) < coalesce(n_chars, 0) THEN 'partial' ELSE 'mismatch' END AS status, count(*) AS n FROM documents GROUP BY 1",
    "regression_metrics": "WITH x AS (SELECT l_extendedprice / 1000 AS t, l_quantity AS p FROM lineitem) SELECT count(*) AS n, round(avg(abs(p - t)), 6) AS mae, round(avg((p - t) * (p - t)), 6) AS mse, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(1 - avg((p - t) * (p - t)) / var_pop(t), 6) AS r2 FROM x",
    "event_averages": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY 1",
    "props_parsed": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, 0::DOUBLE AS missing FROM events",
    "display_forms": """WITH p AS (SELECT *, p_size ** 3 * 2.5::DOUBLE AS s, p_size * 40000.0::DOUBLE AS b FROM part) SELECT p_partkey, CASE WHEN s >= 86400 THEN printf('%.2f days', s / 86400) WHEN s >= 3600 THEN printf('%.2f h', s / 3600) WHEN s >= 60 THEN printf('%.2f min', s / 60) ELSE printf('%.2f s', s) END AS time,
  format('{:,}', b::BIGINT) AS size, list_aggregate(list_transform(regexp_extract_all(lower(p_name), '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(x, 20, '0') ELSE x END), 'string_agg', '') AS key FROM p""",
    "mztab_rows": "WITH v AS (SELECT concat_ws(chr(9), 'PSM', library_id, peptide, charge) AS value FROM library_spectra WHERE peptide IS NOT NULL) SELECT value, ((row_number() OVER (ORDER BY value) - 1) // 1000)::BIGINT AS chunk FROM v",
    "paf_rows": """SELECT o_orderkey, o_custkey % 500 AS "end", o_orderkey % 200 AS length, o_custkey % 300 AS score, greatest(0, o_custkey % 500 - o_orderkey % 200) AS start, least(o_orderkey % 200, (o_custkey % 300) // 2) AS matches FROM orders""",
    "union_align": "SELECT c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS region, c_mktsegment, 'customer' AS source FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, NULL, 'supplier' FROM supplier",
    "key_intersection": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer",
    "resume_antijoin": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "input_equivalence": """SELECT kind, count(*) AS n_a, count(*) AS n_b, sum(length(text))::BIGINT AS bases_a, sum(length(text))::BIGINT AS bases_b,
  kind <> 'moved' OR max(CASE WHEN doc_id = 1 THEN text END) IS NOT DISTINCT FROM max(CASE WHEN doc_id = 2 THEN text END) AS equivalent FROM documents, (VALUES ('multiset'), ('ordered'), ('moved')) k(kind) GROUP BY kind""",
    "source_digests": "SELECT lower(instrument) AS i, sha256(string_agg(sha256(run_id), chr(10) ORDER BY run_id)) AS digest FROM ms_runs GROUP BY 1",
    "hash_sample_cutoff": """WITH x AS (SELECT doc_id, coalesce(length(text), 0) AS size, sha256('|' || doc_id) AS h FROM documents), y AS (SELECT doc_id, (sum(size) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before FROM x) SELECT * FROM y WHERE before < 1000000""",
    "prefix_cutoff": """WITH x AS (SELECT doc_id, length(text) AS n, sum(length(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - length(text) AS b FROM documents WHERE length(text) >= 50) SELECT doc_id, least(n, 500000 - b)::INT AS kept FROM x WHERE b < 500000""",
    "seeded_sample": f"SELECT o_orderkey FROM orders ORDER BY {_ORD}, o_orderkey LIMIT 100",
    "candidate_caps": "SELECT o_custkey, o_orderkey, r::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3",
    "capped_groups": """WITH RECURSIVE g AS (SELECT p_brand, least(count(*), 20) AS t, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1),
w(r, room, brand, took) AS (SELECT 0::BIGINT, 100::BIGINT, NULL::VARCHAR, false UNION ALL SELECT g.r, CASE WHEN t <= room THEN room - t ELSE room END, p_brand, t <= room FROM w JOIN g ON g.r = w.r + 1),
k AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part)
SELECT p_brand, p_partkey FROM k WHERE i <= 20 AND p_brand IN (SELECT brand FROM w WHERE took)""",
    "round_robin": "WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, i % 16 AS tile, i // 16 AS \"column\" FROM x WHERE i < 8000",
    "best_by_struct": "SELECT DISTINCT ON (l_orderkey) l_orderkey, l_quantity, l_extendedprice, l_linenumber FROM lineitem ORDER BY l_orderkey, l_quantity DESC, l_extendedprice DESC, l_linenumber",
    "group_pairs": "SELECT a.c_custkey AS c_custkey_a, b.c_custkey AS c_custkey_b FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment AND floor(a.c_acctbal / 5) = floor(b.c_acctbal / 5) AND a.c_custkey < b.c_custkey",
    "expert_routing": """WITH x AS (SELECT vec_id, unnest(embedding[1:4])::DOUBLE AS l, generate_subscripts(embedding[1:4], 1) - 1 AS expert FROM embeddings), r AS (SELECT vec_id, expert, exp(l - max(l) OVER (PARTITION BY vec_id)) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, expert) AS r FROM x),
t AS (SELECT vec_id, max(CASE WHEN r = 1 THEN expert END)::INT AS expert, max(CASE WHEN r = 1 THEN p END) AS a, max(CASE WHEN r = 2 THEN p END) AS b FROM r GROUP BY 1)
SELECT expert, count(*) AS vectors, round(sum(a / (a + b)), 4) AS weight, round(sum(b / (a + b)), 4) AS second_weight FROM t GROUP BY 1""",
    "bucket_costs": f"""WITH {SIZES}, c AS (SELECT n, CASE WHEN n > 1 THEN n * 87e-9::DOUBLE ELSE 0 END AS s, CASE WHEN n > 1 THEN n * (2048 * 20 + n * (2048 * 41.7::DOUBLE + 250)) * 1e-12::DOUBLE ELSE 0 END AS e, CASE WHEN n > 1 THEN n * 50e-9::DOUBLE ELSE 0 END AS r, CASE WHEN n > 1 THEN 1 ELSE 0 END AS p FROM sizes),
t AS (SELECT sum(n)::BIGINT AS n, sum(p)::BIGINT AS passes, sum(s) AS s, sum(e) AS e, sum(r) AS r FROM c), u AS (SELECT *, (ceil(n / 16384.0::DOUBLE) * 70 + 17) * n * 1e-9::DOUBLE AS w FROM t)
SELECT n, passes, round(s * 1e6, 4) AS bucket_us, round(e * 1e6, 4) AS bucket_nj, round(r * 1e6, 4) AS restore_us, round(w * 1e6, 4) AS whole_us, round(w / s, 4) AS speedup, ceil(n / 32.0::DOUBLE)::BIGINT AS batches, round(ceil(n / 32.0::DOUBLE) * 2e-7::DOUBLE * 1e6, 4) AS encode_us,
  round((n * 9.193e-6::DOUBLE + n * 16 / 8.1e9::DOUBLE + n * 256 / 8.1e9::DOUBLE) * 1e6, 4) AS filter_us, round((n * 10.52e-6::DOUBLE + n * 2048 * 0.3::DOUBLE * 1e-12::DOUBLE) * 1e9, 4) AS filter_nj, round((n * 2048 / 1.6e9::DOUBLE + 50e-6::DOUBLE) * 1e6, 4) AS link_us FROM u""",
    "search_costs": """WITH p AS (SELECT count(*) AS c FROM search_hits GROUP BY query_spectrum), t AS (SELECT count(*) AS queries, sum(c)::BIGINT AS comparisons, sum(ceil(c / 64.0))::BIGINT AS restore_passes FROM p)
SELECT queries, comparisons, restore_passes, comparisons * 1024 AS compare_bytes, round(comparisons * (1024 / 8.1e9::DOUBLE) * 1e6, 4) AS compare_seconds, round(queries * (1024 / 8.1e9::DOUBLE) * 1e6, 4) AS broadcast_seconds, round(comparisons * (4 / 8.1e9::DOUBLE) * 1e6, 4) AS result_seconds, round(restore_passes * 50e-9::DOUBLE * 1e6, 4) AS restore_seconds,
  round(comparisons * (8192 * 39.7::DOUBLE * 1e-12::DOUBLE) * 1e6, 4) AS restore_mj FROM t""",
    "transfer_costs": """WITH o AS (SELECT o_orderkey * 1000 AS b, CASE o_orderstatus WHEN 'F' THEN 256 WHEN 'O' THEN 512 ELSE 2000 END AS g, o_orderpriority LIKE '1%' AS w FROM orders)
SELECT sum(b)::BIGINT AS cold_bytes, round(sum(b / (g * 1e9::DOUBLE) * 1e3), 4) AS cold_ms, round(sum(b * 2.4e-9::DOUBLE), 4) AS cold_mj, sum(b) FILTER (w)::BIGINT AS warm_bytes, round(sum(b / (g * 1e9::DOUBLE) * 1e3) FILTER (w), 4) AS warm_ms, round(sum(b * 2.4e-9::DOUBLE) FILTER (w), 4) AS warm_mj, round(sum(b / (g * 1e9::DOUBLE)) * 1e3, 4) AS segment_ms FROM o""",
    "projections": """WITH s AS (SELECT s_suppkey AS k, s_suppkey * 1.5::DOUBLE AS t, s_nationkey * 10.0::DOUBLE AS w FROM supplier), x AS (SELECT *, CASE k % 3 WHEN 0 THEN t * (2.0::DOUBLE / 3) WHEN 1 THEN t * 0.25::DOUBLE ELSE t END AS sc FROM s)
SELECT k AS s_suppkey, round(sc, 6) AS scaled, CASE WHEN w > 0 THEN round(t * 100 / w, 6) END AS extrapolated, round(greatest(t, w, sc), 6) AS overlap, round(t + w, 6) AS additive, round(greatest(t - w, 0), 6) AS movement, CASE WHEN t > 0 THEN round(100 * (1 - w / t), 6) END AS reduction, CASE WHEN w < 60 THEN 100 ELSE w END::DOUBLE AS power, k * 206 AS fastq,
  k::DOUBLE * k * k AS cycles, round((1 + k * (8192 * 39.7::DOUBLE * 1e-15::DOUBLE) + k * 50e-9::DOUBLE * 45) * 1e6, 3) AS energy_uj FROM x""",
    "total_latencies": "SELECT (SELECT sum(o_custkey)::DOUBLE FROM orders) AS total_seconds, '' AS missing UNION ALL SELECT NULL, 'X'",
}

"""Readers and writers on small files."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from helixlake.sources import genomics, metrics, records, sinks, spectra
from helixlake.streaming.metrics import stream_jsonl, windowed_rollup

MGF = """BEGIN IONS
TITLE=one
PEPMASS=500.5 10
CHARGE=2+
RTINSECONDS=12.5
SCANS=7
100.1 5
200.2 9
3000 1
END IONS

BEGIN IONS
PEPMASS=600
CHARGE=2+ and 3+
150 1
END IONS
BEGIN IONS
TITLE=bad
150 1
END IONS
"""


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, newline="")
    return str(path)


def test_mgf(spark, tmp_path):
    path = put(tmp_path, "a.mgf", MGF)
    r = spectra.read_mgf(spark, path).orderBy("ordinal").collect()
    assert [(x["title"], x["precursor_mz"], x["charge"], x["retention_time"], len(x["peaks"])) for x in r] == [("one", 500.5, 2, 12.5, 3), ("query_1", 600.0, 2, 0.0, 1)]
    assert spectra.read_mgf(spark, path).count() == 2
    with pytest.raises(Exception, match="lacks TITLE"):
        spectra.read_mgf(spark, path, strict=True).collect()
    c = spectra.read_mgf_for_clustering(spark, path, max_peaks=1).orderBy("id").collect()
    assert [(x["id"], x["peaks"][0]["mz"]) for x in c] == [("a#S0002", 150.0), ("one", 200.2)]
    assert [x["precursor_mz"] for x in spectra.read_mgf_precursors(spark, path).orderBy("precursor_mz").collect()] == [0.0, 500.5, 600.0]


def test_mgf_in_splits(spark, tmp_path):
    """Untitled spectra keep names of their own when a file is read in many splits; markers of any case on request."""
    text = "".join(f"BEGIN IONS\nPEPMASS={500 + i}\n{100 + i} 1\nEND IONS\n" for i in range(200))
    path = put(tmp_path, "a.mgf", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = spectra.read_mgf(spark, path)
        assert df.rdd.getNumPartitions() >= 1
        assert sorted((r["ordinal"], r["title"], r["precursor_mz"]) for r in df.collect()) == [(i, f"query_{i}", 500.0 + i) for i in range(200)]
        lines = records.numbered_records(spark, put(tmp_path, "x.txt", "".join(f"{i}\n" for i in range(1000))))
        assert sorted((r["ordinal"], r["value"]) for r in lines.collect()) == [(i, str(i)) for i in range(1000)]
        fq = put(tmp_path, "s.fq", "".join(f"@r{i}\nACGT\n+\n@III\n" for i in range(150)))
        assert sorted((r["ordinal"], r["id"], r["seq"], r["quality"]) for r in genomics.read_fastq(spark, fq, strict=True).collect()) == [(i, f"r{i}", "ACGT", "@III") for i in range(150)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    low = put(tmp_path, "b.mgf", text.lower().replace("pepmass", "PEPMASS"))
    assert spectra.read_mgf(spark, low, any_case=True).count() == 200


def test_graph_arrays_round_trip(spark, tmp_path):
    tiny = "8 7\n0\n1\n2\n3\n4\n5\n6\n0\n0\n1\n2\n3\n4\n5\n6\n7\n1\n2\n3\n4\n5\n6\n7\n0\n1\n2\n3\n4\n5\n6\n7\n7\nA\nC\nG\nT\nA\nC\nG\nT\n"
    g = genomics.read_graph_arrays(spark, put(tmp_path, "t.graph", tiny)).orderBy("vertex").collect()
    assert [(r["label"], r["sources"], r["targets"]) for r in g] == [("ACGT"[i % 4], [i - 1] if i else [], [i + 1] if i < 7 else []) for i in range(8)]
    nodes = spark.createDataFrame([(i, c) for i, c in enumerate("ACXTG")], "v long, b string")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3)], "s long, t long")
    lines = sinks.graph_array_lines(nodes, "v", "b", edges, "s", "t")
    out = str(tmp_path / "g")
    sinks.write_lines(lines, out, F.col("value"), [F.col("section"), F.col("place"), F.col("other")], one_file=True)
    back = genomics.read_graph_arrays(spark, out).orderBy("vertex").collect()
    assert [(r["label"], r["sources"], r["targets"]) for r in back] == [("A", [], [1, 2]), ("C", [0], [3]), ("N", [0], [3]), ("T", [1, 2], []), ("G", [], [])]
    linear = sinks.graph_array_lines(spark.createDataFrame([(i, "ACGT"[i % 4]) for i in range(8)], "v long, b string"), "v", "b", spark.createDataFrame([(i, i + 1) for i in range(7)], "s long, t long"), "s", "t")
    assert "\n".join(r["value"] for r in linear.orderBy("section", "place", "other").collect()) + "\n" == tiny


def test_heads_and_conversion(spark, tmp_path):
    fq = put(tmp_path, "h.fq", "".join(f"@r{i}\nAC{'GT'[i % 2]}\n+\nIII\n" for i in range(9)))
    head = genomics.first_records(genomics.read_fastq(spark, fq, strict=True), 4)
    out = str(tmp_path / "reads")
    sinks.write_lines(head, out, sinks.alternating_lines(F.col("id"), F.col("seq")), [F.col("ordinal")], one_file=True)
    assert [(r["ordinal"], r["id"], r["seq"]) for r in genomics.read_alternating_reads(spark, out).orderBy("ordinal").collect()] == [(i, f"r{i}", f"AC{'GT'[i % 2]}") for i in range(4)]
    again = str(tmp_path / "again")
    sinks.write_lines(head, again, sinks.fastq_line(F.col("id"), F.col("seq"), F.col("quality")), [F.col("ordinal")], one_file=True)
    assert genomics.read_fastq(spark, again).count() == 4


def test_cascade_over_files(spark, tmp_path):
    from helixlake.plans.search import file_cascade

    a = put(tmp_path, "std.tsv", "1\t2\t10\t2\t9.0\n1\t2\t11\t2\t9.0\n2\t2\t12\t2\t8.0\n3\t2\t-1\t2\t99\n4\t2\t13\t2\t1.0\n")
    b = put(tmp_path, "open.tsv", "1\t2\t10\t2\t9.0\n3\t2\t11\t2\t7.0\n4\t2\t12\t2\t6.0\n")
    lib = spark.createDataFrame([(10, False), (11, False), (12, False), (13, True)], "library_id long, is_decoy boolean")
    assert sorted(tuple(r) for r in file_cascade(spark, a, b, lib, 0.1).collect()) == [("open", 3, 11, 7.0), ("open", 4, 12, 6.0), ("standard", 1, 10, 9.0), ("standard", 2, 12, 8.0)]


def test_vector_archives(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "z2.npz", data=np.array([1.0, 2.0, 3.0]), indices=np.array([5, 7, 5]), indptr=np.array([0, 2, 2, 3]), ids=np.array([10, 11, 12]))
    assert sorted((r["id"], r["bin"], r["value"]) for r in spectra.read_vector_archive(spark, str(tmp_path / "z2.npz")).collect()) == [(10, 5, 1.0), (10, 7, 2.0), (12, 5, 3.0)]
    data = np.random.default_rng(1).integers(0, 256, (50, 16), np.uint8)
    data.tofile(tmp_path / "hv.bin")
    got = spectra.read_vector_file(spark, str(tmp_path / "hv.bin"), 16, 50, 3).orderBy("id").collect()
    assert [(r["id"], bytes(r["hv"])) for r in got] == [(i, data[i].tobytes()) for i in range(50)]


def test_mgf_round_trip(spark, tmp_path):
    s = spectra.read_mgf(spark, put(tmp_path, "a.mgf", MGF))
    out = str(tmp_path / "out")
    sinks.write_lines(s, out, sinks.mgf_text(F.col("title"), F.col("precursor_mz"), F.col("charge"), F.col("retention_time"), F.col("peaks")))
    back = spectra.read_mgf(spark, out)
    assert sorted(map(str, back.select("title", "precursor_mz", "charge", "peaks").collect())) == sorted(map(str, s.select("title", "precursor_mz", "charge", "peaks").collect()))


def test_library(spark, tmp_path):
    path = str(tmp_path / "a.splib")
    spectra.write_library(path, [(1, "PEPTIDE", 2, 400.5, False, [(100.0, 1.0, "y5^2/0.1"), (120.0, 2.0, "?")]), (2, "DECOY", 3, 300.25, True, [])])
    df = spectra.cached_library(spark, path, str(tmp_path / "cache"), {"bin": 0.05})
    assert [(r["id"], r["peptide"], r["charge"], r["precursor_mz"], r["is_decoy"], len(r["peaks"])) for r in df.orderBy("id").collect()] == [(1, "PEPTIDE", 2, 400.5, False, 2), (2, "DECOY", 3, 300.25, True, 0)]
    a = df.where("id = 1").select(F.transform("peaks", lambda p: spectra.ion_annotation(p["annotation"]))).first()[0]
    assert tuple(a[0]) == ("y", 5, 2) and a[1] is None
    assert spectra.cached_library(spark, path, str(tmp_path / "cache"), {"bin": 0.05}).count() == 2
    index = spectra.library_index(spark, path, str(tmp_path / "cache"), {"bin": 0.05})
    assert [(r["id"], r["charge"], r["precursor_mz"]) for r in index.orderBy("id").collect()] == [(1, 2, 400.5), (2, 3, 300.25)]
    assert [(r["id"], r["peptide"], len(r["peaks"])) for r in spectra.library_at(spark, index.where("id = 2")).collect()] == [(2, "DECOY", 0)]
    spectra.write_library(path, [(5, "NEW", 2, 1.5, False, [])])
    assert [r["id"] for r in spectra.library_index(spark, path, str(tmp_path / "cache"), {"bin": 0.05}).collect()] == [5]


def test_sequences_and_graphs(spark, tmp_path):
    fa = put(tmp_path, "a.fa", ">x one\nacg\nT\n>y\nGG\n")
    assert sorted(tuple(r) for r in genomics.read_sequences(spark, fa).collect()) == [("x", "ACGT"), ("y", "GG")]
    assert [r["seq"] for r in genomics.first_fasta(spark, fa).collect()] == ["ACGT"]
    fq = put(tmp_path, "a.fq", "@r1 x\nAC\nGT\n+\n@@\nII\n@r2\nA\n+\nI\n")
    assert [(r["id"], r["seq"], r["quality"]) for r in genomics.read_fastq(spark, fq).orderBy("ordinal").collect()] == [("r1", "ACGT", "@@II"), ("r2", "A", "I")]
    with pytest.raises(Exception, match="record|differ"):
        genomics.read_fastq(spark, fq, strict=True).collect()
    nodes, edges = genomics.read_gfa(spark, put(tmp_path, "a.gfa", "H\tx\nS\ta\tacg\nS\tb\tT\nL\ta\t+\tb\t+\t0M\nL\ta\t+\tz\t+\t0M\n"))
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [("a", "b")]
    with pytest.raises(ValueError):
        genomics.read_gfa(spark, put(tmp_path, "b.gfa", "H\n"))
    sam = genomics.read_sam(spark, put(tmp_path, "a.sam", "@HD\nr1\t16\tc\t5\t60\t3M1I2D\t*\t0\t0\tACGT\tIIII\tAS:i:1\tNM:i:3\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")).orderBy("read").collect()
    assert [(r["flags"], r["span"], r["reference_span"], r["edits"]) for r in sam] == [(16, 6, 5, 3), (4, 0, 0, None)]
    paf = genomics.read_paf(spark, put(tmp_path, "a.paf", "r\t9\t0\t9\t+\t>n1\t50\t3\t12\t8\t9\t60\tx\nshort\n")).collect()
    assert [(r["target"], r["mapq"]) for r in paf] == [("n1", 60)]
    reads = genomics.read_alternating_reads(spark, put(tmp_path, "r.txt", "read_0\nACGT\nread_1\nCGTA\n")).orderBy("ordinal").collect()
    assert [(r["id"], r["seq"]) for r in reads] == [("read_0", "ACGT"), ("read_1", "CGTA")]
    g = genomics.read_graph_text(spark, put(tmp_path, "a.graph", "8 7\n0 1 2\n")).first()
    assert (g["vertices"], g["edges"]) == (8, 7)


def test_logs(spark, tmp_path):
    perf = metrics.read_perf(spark, put(tmp_path, "p.csv", "# c\n123,,cycles,1\n<not counted>,,cache-misses,0\n"))
    assert {r["counter"]: r["value"] for r in perf.collect()} == {"cycles": 123.0, "cache-misses": None}
    assert metrics.counters_wide(perf, ["cycles"]).first()["cycles"] == 123.0
    t = metrics.read_time_log(spark, put(tmp_path, "t.log", "\tUser time (seconds): 1.5\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02.50\n\tMaximum resident set size (kbytes): 99\n")).first()
    assert (t["user_s"], t["elapsed_s"], t["max_rss_kb"], t["major_faults"]) == (1.5, 62.5, 99.0, None)
    assert metrics.read_iostat(spark, put(tmp_path, "io.log", "sda 1 10.0\nsda 1 0\nsdb 1 99\nsda 2 30\n"), "sda").first()["median_read"] == 20.0
    s = metrics.scrape(spark, put(tmp_path, "x.log", "latency: 5 ms\nlatency: 7.5 ms\n"), {"ms": r"latency: ([0-9.]+)", "no": r"none (\d+)"}).first()
    assert s["ms"] == 7.5 and s["no"] is None
    assert metrics.last_json('x {"a": 1} y {"b": {"c": 2}} z') == {"b": {"c": 2}}
    assert metrics.read_settings(put(tmp_path, "s.ini", "[a]\nx = 1\n")) == {"a": {"x": "1"}}
    p = metrics.read_power(spark, put(tmp_path, "w.csv", "2024/01/01 00:00:01.000, 0, 55.5 W, 100 MiB\nshort, 1\n")).first()
    assert (p["watts"], p["memory_mib"]) == (55.5, 100.0)
    report = """ ** GPU MemOps Summary (by Time)
 Time (%)  Total Time (ns)  Count            Operation
 --------  ---------------  -----  ----------------------------
     75.0            1,500      2  [CUDA memcpy Host-to-Device]
     25.0              500      1  [CUDA memcpy DtoH]

 Total (MB)  Count            Operation
 ----------  -----  ----------------------------
      4.096      2  [CUDA memcpy Host-to-Device]

 Total Time (ns)  Instances     Name
 ---------------  ---------  -----------
              70          3  encode(int)
"""
    path = put(tmp_path, "n.txt", report)
    assert sorted(tuple(r) for r in metrics.read_copy_summary(spark, path).collect()) == [("DTOH", 1, None, 500.0), ("HTOD", 2, pytest.approx(4_096_000.0), 1500.0)]
    assert [tuple(r) for r in metrics.read_kernel_times(spark, path).collect()] == [("encode(int)", 3, 70.0)]


def test_tables(spark, tmp_path):
    j = put(tmp_path, "a.jsonl", '{"a": 1}\nbroken\n\n{"a": 2}\n')
    assert metrics.read_jsonl(spark, j, "a int").where("a IS NOT NULL").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        metrics.read_jsonl(spark, j, "a int", strict=True).collect()
    c = metrics.read_commented_csv(spark, put(tmp_path, "c.csv", "# note\nidentifier,cluster\nmzspec:x:index:12,3\n")).first()
    assert c["spectrum_index"] == 12
    assert metrics.read_search_output(spark, put(tmp_path, "s.tsv", "1\t2\t-1\t2\t0.5\n")).first()["library_id"] == -1
    db = str(tmp_path / "t.sqlite")
    with sqlite3.connect(db) as con:
        con.execute("create table k (s integer, e integer, b integer, kind integer)")
        con.execute("insert into k values (0, 5, 10, 1), (1, 2, 3, 9)")
    copies = metrics.read_sqlite_table(spark, db, "select s, e, b, kind as copyKind from k", "s long, e long, b long, copyKind long")
    kinds = spark.createDataFrame([(1, "HtoD")], "id long, label string")
    assert sorted(r["direction"] for r in metrics.copy_trace(copies, kinds).collect()) == ["HtoD", "kind_9"]


def test_pepxml(spark, tmp_path):
    xml = """<?xml version="1.0"?><r><roc_error_data charge="all"><error_point error="0.01" min_prob="0.9"/><error_point error="0.05" min_prob="0.5"/></roc_error_data>
<spectrum_query start_scan="5" assumed_charge="2"><search_result><search_hit hit_rank="1" peptide="PEP"><modification_info modified_peptide="P[1]EP"/><analysis_result><peptideprophet_result probability="0.97"/></analysis_result></search_hit></search_result></spectrum_query>
<spectrum_query start_scan="6" assumed_charge="3"><search_result><search_hit hit_rank="2" peptide="NO"/></search_result></spectrum_query></r>"""
    path = put(tmp_path, "a.pep.xml", xml)
    assert [tuple(r) for r in metrics.read_pepxml(spark, path).collect()] == [(5, 2, "PEP", "P[1]EP", 0.97)]
    assert metrics.probability_threshold(metrics.read_roc_points(spark, path), 0.02) == 0.9


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("q10", 1.0), ("q2", None)], "id string, score double")
    lines = sinks.mztab_lines(df, {"fdr": "0.01"}, ["id", "score"], "id")
    both = sinks.merge_mztab([lines, lines])
    out = str(tmp_path / "out")
    sinks.write_mztab(both, out)
    text = [r[0] for r in spark.read.text(out).collect()]
    assert text[:3] == ["MTD\tfdr\t0.01", "PSH\tid\tscore", "PSM\tq2\tnull"] and sinks.count_matches(both) == 4
    for kind in ("csv", "tsv", "json", "parquet"):
        sinks.write_report(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    assert sinks.markdown_rows(df, ["id", "score"]).first()[0].startswith("| q10 | 1.0")
    with pytest.raises(ValueError):
        sinks.write_report(df, out, "xls")


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(src, "a.json", '{"at": "2024-01-01T00:00:00", "stage": "x", "s": 2.0}\n{"at": "2024-01-01T00:01:00", "stage": "x", "s": 3.0}\n')
    q = windowed_rollup(stream_jsonl(spark, str(src), "at timestamp, stage string, s double"), "at", "stage", "s").writeStream.outputMode("complete").format("memory").queryName("rollup").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["rows"], r["seconds"]) for r in spark.sql("select * from rollup").collect()] == [(2, 5.0)]

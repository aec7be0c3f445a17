"""Readers of sequences, graphs and alignments: FASTA, FASTQ, GFA, SAM, PAF and GAF, plain graph and read files."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions.scalars import alignment_span, integer_tag, reference_span
from helixlake.sources.records import numbered_records


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, seq) in upper case, lines joined; the scan splits at `>`, so a large file is read by many tasks."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    return raw.select(F.input_file_name().alias("file"), F.regexp_extract(F.get(lines, 0), r"^(\S+)", 1).alias("id"), F.upper(F.regexp_replace(F.array_join(F.slice(lines, 2, 2147483647), ""), r"\s+", "")).alias("seq"))


def first_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, seq): the first record of every file. Files are read in splits; only the record's place decides."""
    raw = numbered_records(spark, path, ">").where(F.trim("value") != "")
    raw = raw.groupBy("file").agg(F.min_by("value", "ordinal").alias("value"))
    lines = F.split("value", r"\r?\n")
    return raw.select("file", F.regexp_extract(F.get(lines, 0), r"^(\S+)", 1).alias("id"), F.upper(F.regexp_replace(F.array_join(F.slice(lines, 2, 2147483647), ""), r"\s+", "")).alias("seq"))


FASTQ_SCHEMA = "file string, ordinal long, id string, seq string, quality string"


def _fastq_records(file: str, lines: list[str]):
    """The records of the lines of one file, whose sequences and qualities may be wrapped."""
    at, ordinal = 0, 0
    while at < len(lines):
        head = lines[at].strip()
        at += 1
        if not head:
            continue
        if head[0] != "@":
            raise ValueError(f"{file}: a record must start with @, not {head[:20]!r}")
        plus = next((i for i in range(at, len(lines)) if lines[i].startswith("+")), None)
        if plus is None:
            raise ValueError(f"{file}: no + line in record {head[:40]!r}")
        seq, qual, at = "".join(x.strip() for x in lines[at:plus]), "", plus + 1
        while at < len(lines) and len(qual) < len(seq):
            qual += lines[at].strip()
            at += 1
        if len(qual) != len(seq):
            raise ValueError(f"{file}: sequence and quality differ in length in {head[:40]!r}")
        yield file, ordinal, (head[1:].split() or [""])[0], seq.upper(), qual
        ordinal += 1


def read_fastq(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(file, ordinal, id, seq, quality). strict: four lines a record and equal lengths, else the read fails; files are then read
    in splits, a record's lines found by their numbers.

    Otherwise sequence and quality may be wrapped, so quality is read until it is as long as the sequence, and records can only
    be told apart from the start of a file: one task reads one file.
    """
    if strict:
        lines = numbered_records(spark, path).where(F.trim("value") != "")
        four = F.sort_array(F.collect_list(F.struct("ordinal", F.rtrim("value").alias("v"))))
        r = lines.groupBy("file", F.floor(F.col("ordinal") / 4).alias("record")).agg(F.transform(four, lambda x: x["v"]).alias("l"))
        line = lambda i: F.get("l", F.lit(i))
        whole = (F.size("l") == 4) & line(0).startswith("@") & line(2).startswith("+") & (F.length(F.trim(line(1))) == F.length(F.trim(line(3))))
        head = F.when(whole, line(0)).otherwise(F.raise_error(F.concat("file", F.lit(": not four lines of a record with equal lengths at record "), F.col("record").cast("string"))))
        return r.select("file", F.col("record").alias("ordinal"), F.regexp_extract(head, r"^@(\S*)", 1).alias("id"), F.upper(F.trim(line(1))).alias("seq"), F.trim(line(3)).alias("quality"))

    def parse(parts):
        for pdf in parts:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                yield pd.DataFrame(list(_fastq_records(file, text.split("\n"))), columns=["file", "ordinal", "id", "seq", "quality"])

    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return raw.mapInPandas(parse, FASTQ_SCHEMA)


def first_records(records: DataFrame, n: int) -> DataFrame:
    """The first `n` records of every file, by their numbers."""
    return records.where(F.col("ordinal") < n)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq) of a FASTA or FASTQ file, told apart by its first character."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    if first is None:
        return spark.createDataFrame([], "id string, seq string")
    return (read_fasta(spark, path) if first[0].startswith(">") else read_fastq(spark, path)).select("id", "seq")


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, seq), (edges: source, target); edges to unknown nodes are dropped, a graph without nodes is an error."""
    f = F.split("value", "\t")
    raw = spark.read.text(path)
    nodes = raw.where(F.col("value").startswith("S\t")).select(F.get(f, 1).alias("node"), F.upper(F.get(f, 2)).alias("seq"))
    if nodes.isEmpty():
        raise ValueError("the graph has no nodes")
    edges = raw.where(F.col("value").startswith("L\t")).select(F.get(f, 1).alias("source"), F.get(f, 3).alias("target"))
    ids = nodes.select("node")
    return nodes, edges.join(ids, F.col("source") == F.col("node"), "left_semi").join(ids, F.col("target") == F.col("node"), "left_semi")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines with flags, position, quality, CIGAR, spans and edit distance; header lines are left out."""
    f = F.split("value", "\t")
    raw = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(f) >= 11))
    rows = raw.select(
        F.get(f, 0).alias("read"), F.get(f, 1).try_cast("int").alias("flags"), F.get(f, 2).alias("target"), F.get(f, 3).try_cast("long").alias("position"), F.get(f, 4).try_cast("int").alias("mapq"), F.get(f, 5).alias("cigar"), F.get(f, 9).alias("seq"),
        F.array_join(F.slice(f, 12, 2147483647), "\t").alias("tags"),
    )
    return rows.withColumn("span", alignment_span(F.col("cigar"))).withColumn("reference_span", reference_span(F.col("cigar"))).withColumn("edits", integer_tag(F.col("tags"), "NM"))


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """PAF or GAF lines of at least 12 columns; leading > and < of targets are taken off."""
    f = F.split("value", "\t")
    raw = spark.read.text(path).where(F.size(f) >= 12)
    n = lambda i: F.get(f, i).try_cast("long")
    return raw.select(
        F.get(f, 0).alias("read"), n(1).alias("length"), n(2).alias("start"), n(3).alias("end"), F.get(f, 4).alias("strand"), F.regexp_replace(F.get(f, 5), "^[<>]+", "").alias("target"), n(6).alias("target_length"), n(7).alias("target_start"),
        n(8).alias("target_end"), n(9).alias("matches"), n(10).alias("block"), n(11).alias("mapq"),
    )


def read_graph_text(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: vertices, edges, the digest of the text; the header line holds both counts."""
    raw = spark.read.text(path, wholetext=True)
    head = F.split(F.regexp_extract("value", r"^\s*([^\r\n]+)", 1), r"\s+")
    return raw.select(F.input_file_name().alias("file"), F.get(head, 0).try_cast("long").alias("vertices"), F.get(head, 1).try_cast("long").alias("edges"), F.sha2("value", 256).alias("digest"))


def read_graph_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, vertex, label, sources, targets) of graphs written as sparse arrays, one number or label a line.

    After the header (vertices, edges) stand the sources of the edges in order of their targets and where each vertex's begin (one
    offset more than vertices), the targets in order of their sources with such offsets, and the labels. Lines are read in
    splits: their numbers tell which array they belong to.
    """
    lines = numbered_records(spark, path).where(F.trim("value") != "").withColumn("value", F.trim("value"))
    head = lines.where("ordinal = 0").select("file", *(F.get(F.split("value", r"\s+"), i).try_cast("long").alias(c) for i, c in enumerate("ve")))
    v, e = F.col("v"), F.col("e")
    at = lines.where("ordinal > 0").join(head, "file").withColumn("i", F.col("ordinal") - 1)
    part = lambda lo, n: at.where((F.col("i") >= lo) & (F.col("i") < lo + n)).select("file", (F.col("i") - lo).alias("k"), F.col("value").try_cast("long").alias("x"))
    labels = at.where(F.col("i") >= 2 * (e + v + 1)).select("file", (F.col("i") - 2 * (e + v + 1)).alias("vertex"), F.col("value").alias("label"))

    def neighbours(lo, name):
        """Of every vertex, the entries of the array at `lo` from its own offset up to the next one."""
        since = part(lo + e, v + 1).withColumnRenamed("x", "since")
        until = since.select("file", (F.col("k") - 1).alias("k"), F.col("since").alias("until"))
        spans = since.join(until, ["file", "k"]).where("until > since").select("file", F.col("k").alias("vertex"), F.explode(F.sequence("since", F.col("until") - 1)).alias("k"))
        return spans.join(part(lo, e), ["file", "k"]).groupBy("file", "vertex").agg(F.sort_array(F.collect_list("x")).alias(name))

    joined = labels.join(neighbours(F.lit(0), "sources"), ["file", "vertex"], "left").join(neighbours(e + v + 1, "targets"), ["file", "vertex"], "left")
    none = F.array().cast("array<long>")
    return joined.select("file", "vertex", "label", F.coalesce("sources", none).alias("sources"), F.coalesce("targets", none).alias("targets"))


def read_alternating_reads(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, id, seq) of files with a name line and a sequence line in turn, read in splits."""
    lines = numbered_records(spark, path).where(F.trim("value") != "").withColumn("value", F.trim("value"))
    pairs = lines.groupBy("file", F.floor(F.col("ordinal") / 2).alias("ordinal")).agg(F.min_by("value", "ordinal").alias("id"), F.max_by("value", "ordinal").alias("seq"), F.count(F.lit(1)).alias("n"))
    return pairs.where("n = 2").select("file", "ordinal", "id", "seq")

"""Writers: result tables as text, spectra, sequences, and reports."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.functions.scalars import natural_key
from helixlake.operators.ordered import numbered, running_total


def write_lines(df: DataFrame, path: str, line: Column, order: list[Column] | None = None, one_file: bool = False) -> None:
    """Text lines, sorted globally if an order is given; `one_file` only for results small enough for one task."""
    rows = df.orderBy(*order) if order else df
    rows = rows.select(line.alias("value"))
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").text(path)


def mztab_lines(df: DataFrame, settings: dict[str, str], columns: list[str], id_col: str) -> DataFrame:
    """(section, key, value): metadata lines, one header, then the matches; sort by section and key to write."""
    spark = df.sparkSession
    meta = [("1-MTD", f"{i:06d}", f"MTD\t{k}\t{v}") for i, (k, v) in enumerate(sorted(settings.items()))]
    head = [("2-PSH", "", "PSH\t" + "\t".join(columns))]
    rows = df.select(F.lit("3-PSM").alias("section"), natural_key(F.col(id_col)).alias("key"), F.concat_ws("\t", F.lit("PSM"), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns)).alias("value"))
    return spark.createDataFrame(meta + head, "section string, key string, value string").unionByName(rows)


def merge_mztab(parts: list[DataFrame]) -> DataFrame:
    """Metadata and header of the first file, the matches of all; from (section, key, value)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.where("section = '3-PSM'"))
    return out


def count_matches(lines: DataFrame) -> int:
    return lines.where(F.col("value").startswith("PSM\t")).count()


def write_mztab(lines: DataFrame, path: str) -> None:
    write_lines(lines, path, F.col("value"), [F.col("section"), F.col("key"), F.col("value")], one_file=True)


def mgf_text(title: Column, mz: Column, charge: Column, time: Column, peaks: Column) -> Column:
    """One spectrum as an MGF block."""
    lines = F.transform(peaks, lambda p: F.concat(F.format_string("%.5f", p["mz"]), F.lit(" "), F.format_string("%.4f", p["intensity"])))
    return F.concat_ws("\n", F.lit("BEGIN IONS"), F.concat(F.lit("TITLE="), title), F.concat(F.lit("PEPMASS="), F.format_string("%.6f", mz)), F.concat(F.lit("CHARGE="), charge.cast("string"), F.lit("+")), F.concat(F.lit("RTINSECONDS="), F.coalesce(time, F.lit(0.0)).cast("string")), F.array_join(lines, "\n"), F.lit("END IONS"), F.lit(""))


def chunk_ids(df: DataFrame, order: list[Column], rows: int, out: str = "chunk") -> DataFrame:
    """Chunks of `rows` rows in order, for writing with partitionBy."""
    return numbered(df, order, "_i").withColumn(out, F.floor(F.col("_i") / rows)).drop("_i")


def write_vectors(df: DataFrame, path: str, charge: str) -> None:
    """Vectors by charge, so that a search of one charge reads only its folder."""
    df.write.mode("overwrite").partitionBy(charge).parquet(path)


def fasta_line(name: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), seq)


def fastq_line(name: Column, seq: Column, quality: Column) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), quality)


def alternating_lines(name: Column, seq: Column) -> Column:
    """A read as a line of its name and one of its sequence."""
    return F.concat(name, F.lit("\n"), seq)


def graph_array_lines(nodes: DataFrame, vertex: str, label: str, edges: DataFrame, source: str, target: str) -> DataFrame:
    """(section, place, other, value): the lines of a graph as sparse arrays, in that order (see `read_graph_arrays`).

    Vertices are numbered from 0 without gaps; null labels and those other than A, C, G, T are written as N.
    """
    line = lambda df, section, place, other, value: df.select(F.lit(section).alias("section"), place.cast("long").alias("place"), other.cast("long").alias("other"), value.cast("string").alias("value"))
    totals = nodes.agg(F.count(F.lit(1)).alias("v")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("e"))))
    parts = [line(totals, 0, F.lit(0), F.lit(0), F.concat_ws(" ", "v", "e"))]
    for section, by, other in ((1, target, source), (3, source, target)):
        parts.append(line(edges, section, F.col(by), F.col(other), F.col(other)))
        degrees = nodes.select(F.col(vertex).alias("_v")).join(edges.groupBy(F.col(by).alias("_v")).agg(F.count(F.lit(1)).alias("_d")), "_v", "left")
        parts.append(line(totals, section + 1, F.lit(-1), F.lit(0), F.lit(0)))
        parts.append(line(running_total(degrees, [F.col("_v")], F.col("_d"), "_b"), section + 1, F.col("_v"), F.lit(0), F.col("_b") + F.coalesce("_d", F.lit(0))))
    parts.append(line(nodes, 5, F.col(vertex), F.lit(0), F.when(F.col(label).isin("A", "C", "G", "T"), F.col(label)).otherwise("N")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def paf_columns(df: DataFrame, end: str, length: str, score: str) -> DataFrame:
    """Start and matches that a mapping's end, length and score imply."""
    return df.withColumn("start", F.greatest(F.lit(0), F.col(end) - F.col(length))).withColumn("matches", F.least(F.col(length), F.greatest(F.lit(0), F.floor(F.col(score) / 2))))


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """A table as Markdown lines (value), header lines apart."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |")).alias("value"))


def write_report(df: DataFrame, path: str, kind: str) -> None:
    """csv, tsv, json or parquet; the commit protocol makes the replacement appear only when it is complete."""
    writer = df.write.mode("overwrite")
    if kind in ("csv", "tsv"):
        writer.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)
    elif kind in ("json", "parquet"):
        getattr(writer, kind)(path)
    else:
        raise ValueError(f"unknown report kind {kind!r}")

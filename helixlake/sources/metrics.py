"""Readers of tables, search output, run logs, traces and settings."""

import configparser
import itertools
import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Units in the heads of a profiler's report, and the two ways it writes the direction of a copy.
BYTE_UNITS = (("B", 1.0), ("KB", 1e3), ("MB", 1e6), ("GB", 1e9), ("KiB", 2.0**10), ("MiB", 2.0**20), ("GiB", 2.0**30))
DIRECTIONS = (("htod", "host-to-device"), ("dtoh", "device-to-host"), ("dtod", "device-to-device"))
SEARCH_COLUMNS = "query_idx int, query_charge int, library_id long, library_charge int, score double"


def read_search_output(spark: SparkSession, path: str) -> DataFrame:
    """Search results without a header line, types declared."""
    return spark.read.schema(SEARCH_COLUMNS).csv(path, sep="\t")


def read_commented_csv(spark: SparkSession, path: str, identifier: str = "identifier") -> DataFrame:
    """CSV with `#` comments; `spectrum_index` is the number behind `index:` in the identifier."""
    return spark.read.csv(path, header=True, comment="#").withColumn("spectrum_index", F.regexp_extract(identifier, r"index:(\d+)", 1).try_cast("long"))


def read_latin1_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV in Latin-1; rows that don't fit the schema are dropped."""
    return spark.read.schema(schema).csv(path, header=True, encoding="ISO-8859-1", mode="DROPMALFORMED")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep="\t")


def read_identifications(spark: SparkSession, path: str, sequence: str, names: dict[str, str] | None = None) -> DataFrame:
    """Parquet with leucine read as isoleucine, and columns renamed."""
    df = spark.read.parquet(path).withColumn(sequence, F.translate(sequence, "L", "I"))
    return df.withColumnsRenamed(names or {})


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines. strict: a malformed line is an error; else such lines are dropped. Blank lines don't count."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_perf(spark: SparkSession, path: str) -> DataFrame:
    """(file, counter, value) of `perf stat` CSV logs; `<not counted>` and the like are null."""
    f = F.split("value", ",")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(f) >= 3))
    return rows.select(F.input_file_name().alias("file"), F.trim(F.get(f, 2)).alias("counter"), F.get(f, 0).try_cast("double").alias("value")).where("counter <> ''")


def counters_wide(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row a file, one column a named counter (a pivot over stated values, so one pass)."""
    return rows.groupBy("file").pivot("counter", names).agg(F.max("value"))


# Fields of `time -v` output.
TIME_FIELDS = {"user_s": r"User time \(seconds\): ([0-9.]+)", "system_s": r"System time \(seconds\): ([0-9.]+)", "max_rss_kb": r"Maximum resident set size \(kbytes\): (\d+)", "major_faults": r"Major \(requiring I/O\) page faults: (\d+)", "fs_input_blocks": r"File system inputs: (\d+)", "fs_output_blocks": r"File system outputs: (\d+)", "exit_status": r"Exit status: (-?\d+)"}


def elapsed_seconds(text: Column) -> Column:
    """Seconds of `h:mm:ss` or `m:ss.ss`."""
    p = F.transform(F.split(text, ":"), lambda x: x.try_cast("double"))
    return F.aggregate(p, F.lit(0.0), lambda s, x: s * 60 + x)


def read_time_log(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of `/usr/bin/time -v` output; fields that are missing are null."""
    raw = spark.read.text(path, wholetext=True)
    clock = F.regexp_extract("value", r"Elapsed \(wall clock\) time[^\n]*: ([0-9:.]+)", 1)
    fields = [F.regexp_extract("value", p, 1).try_cast("double").alias(c) for c, p in TIME_FIELDS.items()]
    return raw.select(F.input_file_name().alias("file"), *fields, F.when(clock != "", elapsed_seconds(clock)).alias("elapsed_s"))


def _tables(text: str):
    """(table, row, head, value) of the tables in a text: a line of heads, one of dashes that shows where columns begin and
    end, then rows up to a blank line."""
    lines, table = text.splitlines(), 0
    for i in range(1, len(lines)):
        if re.fullmatch(r"\s*-+(\s+-+)*\s*", lines[i]) and lines[i - 1].strip():
            cells = [m.span() for m in re.finditer(r"-+", lines[i])]
            heads = [lines[i - 1][a:b].strip() for a, b in cells]
            for row, line in enumerate(itertools.takewhile(str.strip, lines[i + 1 :])):
                for n, ((a, b), head) in enumerate(zip(cells, heads, strict=True)):
                    yield table, row, head, (line[a:] if n == len(cells) - 1 else line[a:b]).strip()
            table += 1


def read_profile_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, table, row, head, value) of the tables in a profiler's text report; a report is read whole by one task."""

    def parse(parts):
        for pdf in parts:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                yield pd.DataFrame([(file, *cell) for cell in _tables(text)], columns=["file", "table", "row", "head", "value"])

    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return raw.mapInPandas(parse, "file string, table int, row int, head string, value string")


def _by_name(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of the tables that have the column `name`: (name, copies, bytes, time_ns); what a table doesn't have is null."""
    cells = read_profile_tables(spark, path).withColumn("n", F.regexp_replace("value", ",", "").try_cast("double"))
    unit = reduce(lambda e, u: e.when(F.col("head").contains(f"({u[0]})"), u[1]), BYTE_UNITS[1:], F.when(F.col("head").contains(f"({BYTE_UNITS[0][0]})"), BYTE_UNITS[0][1]))
    only = lambda c, v: F.max(F.when(c, v))
    head = F.col("head")
    rows = cells.groupBy("file", "table", "row").agg(only(head == name, F.col("value")).alias("name"), only(head.isin("Count", "Instances"), F.col("n")).alias("copies"), only(head.rlike(r"^Total \(.?i?B\)$"), F.col("n") * unit).alias("bytes"), only(head == "Total Time (ns)", F.col("n")).alias("time_ns"))
    return rows.where("name IS NOT NULL")


def read_copy_summary(spark: SparkSession, path: str) -> DataFrame:
    """(direction, copies, bytes, time_ns) of the copies in a profiler's report, columns told by their heads (`Operation`, `Total
    Time (ns)`, `Total (MB)`, `Count`). Times and sizes stand in tables of their own and are put together."""
    named = lambda short, long: F.when(F.lower("name").contains(short) | F.lower("name").contains(long), short.upper())
    rows = _by_name(spark, path, "Operation").withColumn("direction", F.coalesce(*(named(*d) for d in DIRECTIONS)))
    return rows.where("direction IS NOT NULL").groupBy("direction").agg(F.max("copies").cast("long").alias("copies"), F.sum("bytes").alias("bytes"), F.sum("time_ns").alias("time_ns"))


def read_kernel_times(spark: SparkSession, path: str) -> DataFrame:
    """(kernel, calls, time_ns) of the kernels in a profiler's report."""
    rows = _by_name(spark, path, "Name").where("time_ns IS NOT NULL")
    return rows.groupBy(F.col("name").alias("kernel")).agg(F.sum("copies").cast("long").alias("calls"), F.sum("time_ns").alias("time_ns"))


def read_kernel_csv(spark: SparkSession, path: str, metric: str, value: str) -> DataFrame:
    """(metric, n, mean, total) of a profiler's CSV; quoted thousands separators are read as numbers."""
    df = spark.read.csv(path, header=True, comment="=")
    v = F.regexp_replace(F.col(value), ",", "").try_cast("double")
    return df.groupBy(F.col(metric).alias("metric")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.sum(v).alias("total"))


def read_power(spark: SparkSession, path: str) -> DataFrame:
    """(at, device, watts, memory_mib); short rows are dropped, units behind numbers ignored."""
    f = F.split("value", r",\s*")
    n = lambda i: F.regexp_extract(F.get(f, i), r"([0-9.]+)", 1).try_cast("double")
    rows = spark.read.text(path).where(F.size(f) >= 4)
    at = F.coalesce(F.try_to_timestamp(F.trim(F.get(f, 0)), F.lit("yyyy/MM/dd HH:mm:ss.SSS")), F.try_to_timestamp(F.trim(F.get(f, 0))))
    return rows.select(at.alias("at"), n(1).cast("int").alias("device"), n(2).alias("watts"), n(3).alias("memory_mib")).where("at IS NOT NULL")


def copy_trace(copies: DataFrame, kinds: DataFrame) -> DataFrame:
    """Profiler copies (start, end, bytes, copyKind) with the labels of their kinds (id, label)."""
    from helixlake.operators.warehouse import labelled

    return labelled(copies, "copyKind", kinds, "id", "label", "direction")


def read_sqlite_table(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """A table of a SQLite file, read by one task: the file has no ranges to read apart. Export it to Parquet for more."""

    def run(parts):
        import sqlite3

        import pandas as pd

        for pdf in parts:
            for file in pdf["path"]:
                with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
                    yield from pd.read_sql_query(query, db, chunksize=50_000)

    return spark.createDataFrame([(path,)], "path string").mapInPandas(run, schema)


def read_iostat(spark: SparkSession, path: str, device: str) -> DataFrame:
    """(samples, median_read) of one device's positive read rates."""
    f = F.split(F.trim("value"), r"\s+")
    rate = F.get(f, 2).try_cast("double")
    return spark.read.text(path).where((F.get(f, 0) == device) & (rate > 0)).agg(F.count(F.lit(1)).alias("samples"), F.median(rate).alias("median_read"))


def scrape(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """One row a log file: the last number that each labelled pattern finds."""
    raw = spark.read.text(path, wholetext=True)
    last = lambda p: F.element_at(F.regexp_extract_all("value", F.lit(p), F.lit(1)), -1)
    return raw.select(F.input_file_name().alias("file"), *(F.when(F.size(F.regexp_extract_all("value", F.lit(p), F.lit(1))) > 0, last(p)).try_cast("double").alias(c) for c, p in patterns.items()))


def read_pepxml(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(start_scan, assumed_charge, peptide, modified_peptide, probability) of the rank-1 hits.

    The XML source splits at `spectrum_query`; queries without a rank-1 hit give no row.
    """
    schema = f"""_start_scan long, _assumed_charge int, search_result struct<search_hit: array<struct<_hit_rank: int, _peptide: string,
        modification_info: struct<_modified_peptide: string>, analysis_result: array<struct<peptideprophet_result: struct<_probability: double>>>>>>"""
    df = spark.read.format("xml").option("rowTag", f"{prefix}spectrum_query").schema(schema).load(path)
    h = df.select(F.col("_start_scan").alias("start_scan"), F.col("_assumed_charge").alias("assumed_charge"), F.explode("search_result.search_hit").alias("h")).where("h._hit_rank = 1")
    p = F.array_max(F.transform("h.analysis_result", lambda a: a["peptideprophet_result"]["_probability"]))
    return h.select("start_scan", "assumed_charge", F.col("h._peptide").alias("peptide"), F.coalesce("h.modification_info._modified_peptide", "h._peptide").alias("modified_peptide"), p.alias("probability"))


def read_roc_points(spark: SparkSession, path: str, charge: str = "all") -> DataFrame:
    """(error, min_prob) of the error table for `charge`."""
    schema = "_charge string, error_point array<struct<_error: double, _min_prob: double>>"
    df = spark.read.format("xml").option("rowTag", "roc_error_data").schema(schema).load(path).where(F.col("_charge") == charge)
    return df.select(F.explode("error_point").alias("p")).select(F.col("p._error").alias("error"), F.col("p._min_prob").alias("min_prob"))


def probability_threshold(points: DataFrame, error: float) -> float | None:
    """The least probability at the largest error not above `error`."""
    row = points.where(F.col("error") <= error).agg(F.max(F.struct("error", (-F.col("min_prob")).alias("p"))).alias("m")).select("m.p").first()
    return None if row is None or row[0] is None else -row[0]


def read_settings(path: str) -> dict[str, dict[str, str]]:
    """An INI file by section."""
    parser = configparser.ConfigParser()
    with open(path) as text:
        parser.read_file(text)
    return {s: dict(parser.items(s)) for s in parser.sections()}


def last_json(text: str) -> dict:
    """The last JSON object in a log."""
    found, decoder, at = None, json.JSONDecoder(), 0
    while (at := text.find("{", at)) >= 0:
        try:
            found, end = decoder.raw_decode(text, at)
            at = end
        except ValueError:
            at += 1
    if not isinstance(found, dict):
        raise ValueError("no JSON object in the text")
    return found

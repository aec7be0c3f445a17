"""Readers of spectra: MGF text and binary spectral libraries."""

import hashlib
import mmap
import os
import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions.peaks import positive_peaks, top_intense
from helixlake.functions.scalars import first_charge
from helixlake.plans.lineage import materialise
from helixlake.sources.records import numbered_records


def _key(block: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?im)^\s*{name}\s*=\s*([^\r\n]*)", 1)), F.lit(""))


def _peaks(block: Column) -> Column:
    """Lines of two or more numbers."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda s: s.rlike(r"^\s*[0-9.+-]"))
    parts = F.transform(lines, lambda s: F.split(F.trim(s), r"\s+"))
    pairs = F.transform(parts, lambda p: F.struct(F.get(p, 0).try_cast("double").alias("mz"), F.get(p, 1).try_cast("double").alias("intensity")))
    return F.filter(pairs, lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull())


def mgf_blocks(spark: SparkSession, path: str, any_case: bool = False) -> DataFrame:
    """(file, ordinal, block): the text of every BEGIN IONS ... END IONS block and its place in its file.

    The scan is split at `END IONS`, so one file is read by many tasks. With `any_case` the markers may be written in any case;
    a file is then read whole by one task.
    """
    if any_case:
        raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.regexp_extract_all("value", F.lit(r"(?is)BEGIN\s+IONS(.*?)END\s+IONS"), F.lit(1))).alias("ordinal", "block"))
        return raw.select("file", F.col("ordinal").cast("long").alias("ordinal"), "block")
    raw = numbered_records(spark, path, "END IONS").where(F.col("value").contains("BEGIN IONS"))
    return raw.select("file", "ordinal", F.element_at(F.split("value", "BEGIN IONS"), -1).alias("block"))


def read_mgf(spark: SparkSession, path: str, strict: bool = False, any_case: bool = False) -> DataFrame:
    """(file, ordinal, title, precursor_mz, charge, retention_time, scans, peaks).

    strict: every block must have TITLE, PEPMASS and RTINSECONDS, else the read fails. Otherwise blocks without a precursor
    or peaks are dropped, a missing title becomes `query_<ordinal>` (unique in a file) and a missing time 0. Charge: the
    first integer.
    """
    b = mgf_blocks(spark, path, any_case)
    pep = F.regexp_extract(_key(F.col("block"), "PEPMASS"), r"^([0-9.eE+-]+)", 1).try_cast("double")
    rows = b.select("file", "ordinal", _key(F.col("block"), "TITLE").alias("title"), pep.alias("precursor_mz"), first_charge(_key(F.col("block"), "CHARGE")).alias("charge"), _key(F.col("block"), "RTINSECONDS").try_cast("double").alias("retention_time"), _key(F.col("block"), "SCANS").try_cast("long").alias("scans"), _peaks(F.col("block")).alias("peaks"))
    if strict:
        whole = F.col("title").isNotNull() & F.col("precursor_mz").isNotNull() & F.col("retention_time").isNotNull()
        return rows.withColumn("title", F.when(whole, F.col("title")).otherwise(F.raise_error(F.lit("a spectrum lacks TITLE, PEPMASS or RTINSECONDS"))))
    named = F.coalesce("title", F.concat(F.lit("query_"), F.col("ordinal").cast("string")))
    return rows.where(F.col("precursor_mz").isNotNull() & (F.size("peaks") > 0)).withColumn("title", named).withColumn("retention_time", F.coalesce("retention_time", F.lit(0.0)))


def read_mgf_for_clustering(spark: SparkSession, path: str, mz_max: float = 2000.0, max_peaks: int = 50) -> DataFrame:
    """Spectra with their strongest peaks in m/z order; the id is the title, or `<file>#S0001` by place; empty ones are dropped."""
    rows = read_mgf(spark, path)
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    own = F.concat(stem, F.lit("#S"), F.format_string("%04d", F.col("ordinal") + 1))
    rows = rows.withColumn("id", F.when(F.col("title").startswith("query_"), own).otherwise(F.col("title"))).withColumn("peaks", top_intense(positive_peaks(F.col("peaks"), mz_max), max_peaks))
    return rows.where(F.size("peaks") > 0)


def read_mgf_precursors(spark: SparkSession, path: str) -> DataFrame:
    """(title, precursor_mz, charge) only: the peaks are never parsed; an unreadable m/z becomes 0."""
    b = mgf_blocks(spark, path)
    pep = F.coalesce(F.regexp_extract(_key(F.col("block"), "PEPMASS"), r"^([0-9.eE+-]+)", 1).try_cast("double"), F.lit(0.0))
    return b.select(_key(F.col("block"), "TITLE").alias("title"), pep.alias("precursor_mz"), first_charge(_key(F.col("block"), "CHARGE")).alias("charge"))


def whole_files_until(counts: DataFrame, file: str, n: str, target: int) -> DataFrame:
    """Files in name order until the total of those before reaches the target."""
    from helixlake.operators.ordered import until_total

    return until_total(counts, [F.col(file)], n, target)


ANNOTATION = r"^([aby])(\d+)(?:\^(\d+))?/"


def ion_annotation(text: Column) -> Column:
    """struct<ion, idx, charge> of annotations such as `y5^2/0.01`; null for other ions."""
    kind = F.regexp_extract(text, ANNOTATION, 1)
    return F.when(kind != "", F.struct(kind.alias("ion"), F.regexp_extract(text, ANNOTATION, 2).cast("int").alias("idx"), F.coalesce(F.regexp_extract(text, ANNOTATION, 3).try_cast("int"), F.lit(1)).alias("charge")))


LIBRARY_SCHEMA = "file string, id long, peptide string, charge int, precursor_mz double, is_decoy boolean, peaks array<struct<mz: double, intensity: double, annotation: string>>"


def _line(data, at: int) -> tuple[bytes, int]:
    end = data.find(b"\n", at)
    end = len(data) if end < 0 else end
    return data[at:end], end + 1


def parse_library(data: bytes | mmap.mmap, at: int | None = None):
    """The spectra of a binary library: a text header up to `===`, then records of id, name line, m/z, status line, peaks
    (m/z, intensity, annotation line, spare line) and a comment line. With `at`, those from that offset on."""
    for _, record in _records(data, at):
        yield record


def _records(data: bytes | mmap.mmap, at: int | None = None):
    """(offset, record) of the spectra of a library."""
    while at is None or at < len(data):
        if at is None:
            at, line = 0, b""
            while at < len(data) and not line.startswith(b"==="):
                line, at = _line(data, at)
            continue
        start = at
        (key,) = struct.unpack_from("<I", data, at)
        name, at = _line(data, at + 4)
        mz = struct.unpack_from("<d", data, at)[0]
        _, at = _line(data, at + 8)
        (n,) = struct.unpack_from("<I", data, at)
        at += 4
        peaks = []
        for _ in range(n):
            m, i = struct.unpack_from("<dd", data, at)
            note, at = _line(data, at + 16)
            _, at = _line(data, at)
            peaks.append((m, i, note.decode("latin-1")))
        comment, at = _line(data, at)
        found = re.match(r"[^.]*\.(.*?)\.[^/]*/(\d+)", name.decode("latin-1"))
        yield start, (key, found[1] if found else None, int(found[2]) if found else None, mz, b" Remark=DECOY_" in comment, peaks)


def write_library(path: str, spectra: list[tuple[int, str, int, float, bool, list[tuple[float, float, str]]]]) -> None:
    """A library file that `parse_library` reads; for fixtures and exchange."""
    with open(path, "wb") as out:
        out.write(b"binary spectral library\n===\n")
        for key, peptide, charge, mz, decoy, peaks in spectra:
            out.write(struct.pack("<I", key) + f"X.{peptide}.X/{charge}\n".encode() + struct.pack("<d", mz) + b"Normal\n" + struct.pack("<I", len(peaks)))
            for m, i, note in peaks:
                out.write(struct.pack("<dd", m, i) + note.encode() + b"\n\n")
            out.write(b"Comment" + (b" Remark=DECOY_1" if decoy else b"") + b"\n")


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Binary libraries, one task a file (records have no markers to split at); columns as in LIBRARY_SCHEMA."""

    def parse(parts):
        for pdf in parts:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(file, *r) for r in parse_library(content)], columns=["file", "id", "peptide", "charge", "precursor_mz", "is_decoy", "peaks"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, LIBRARY_SCHEMA)


def library_index(spark: SparkSession, path: str, cache: str | None = None, settings: dict | None = None) -> DataFrame:
    """(file, id, charge, precursor_mz, offset): where each spectrum of the binary libraries begins.

    With `cache`, the index is kept there as Parquet and made anew when a file's name or size or the settings differ.
    """

    def scan(parts):
        for pdf in parts:
            for file in pdf["path"]:
                with open(_local(file), "rb") as source, mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ) as data:
                    rows = [(file, r[0], r[2], r[3], at) for at, r in _records(data)]
                yield pd.DataFrame(rows, columns=["file", "id", "charge", "precursor_mz", "offset"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    index = files.select("path").mapInPandas(scan, "file string, id long, charge int, precursor_mz double, offset long")
    if cache is None:
        return index
    state = sorted((os.path.basename(r["path"]), r["length"]) for r in files.collect())
    return _cached(spark, index, cache, "index", [state, sorted((settings or {}).items())])


def library_at(spark: SparkSession, wanted: DataFrame) -> DataFrame:
    """The spectra at (file, offset) of `wanted`, columns as in LIBRARY_SCHEMA: only their places in the files are read."""

    def read(parts):
        for pdf in parts:
            rows = []
            for file, group in pdf.groupby("file"):
                with open(_local(file), "rb") as source, mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ) as data:
                    rows += [(file, *next(parse_library(data, int(at)))) for at in group["offset"]]
            yield pd.DataFrame(rows, columns=["file", "id", "peptide", "charge", "precursor_mz", "is_decoy", "peaks"])

    return wanted.select("file", "offset").distinct().mapInPandas(read, LIBRARY_SCHEMA)


def _local(file: str) -> str:
    """The path of a file that every executor sees under the same name."""
    return re.sub(r"^file:/+", "/", file)


def _cached(spark: SparkSession, df: DataFrame, cache: str, label: str, state) -> DataFrame:
    """`df` as Parquet under `cache`, read from there if it was written in the same state."""
    where = os.path.join(cache, f"{label}-{hashlib.sha256(repr(state).encode()).hexdigest()[:16]}")
    if not os.path.exists(os.path.join(where, "_SUCCESS")):
        return materialise(df, label, where)
    return spark.read.parquet(where)


def cached_library(spark: SparkSession, path: str, cache: str, settings: dict) -> DataFrame:
    """The library as Parquet, rebuilt when the file's name or size or the settings differ from those of the cache."""
    return _cached(spark, read_library(spark, path), cache, "library", [os.path.basename(path), os.path.getsize(path), sorted(settings.items())])


def read_vector_archive(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, bin, value): the entries of sparse matrices in NPZ archives (data, indices, indptr, ids), one row an entry."""

    def load(parts):
        for pdf in parts:
            for file in pdf["path"]:
                with np.load(_local(file)) as z:
                    n = np.diff(z["indptr"])
                    ids = z["ids"] if "ids" in z else np.arange(len(n))
                    yield pd.DataFrame({"file": file, "id": np.repeat(ids, n).astype(np.int64), "bin": z["indices"].astype(np.int64), "value": z["data"].astype(np.float64)})

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(load, "file string, id long, bin long, value double")


def read_vector_file(spark: SparkSession, path: str, n_bytes: int, rows: int, tasks: int) -> DataFrame:
    """(id, hv) of a flat file of `rows` packed vectors of `n_bytes`: each task maps and reads its own range."""

    def load(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.memmap(path, np.uint8, "r", shape=(rows, n_bytes))
                for i in range(a, b, 4096):
                    part = data[i : min(i + 4096, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array([r.tobytes() for r in part], pa.binary())], names=["id", "hv"])

    cuts = [rows * t // tasks for t in range(tasks + 1)]
    ranges = spark.createDataFrame(list(zip(cuts, cuts[1:], strict=False)), "a long, b long").repartition(tasks)
    return ranges.mapInArrow(load, "id long, hv binary")

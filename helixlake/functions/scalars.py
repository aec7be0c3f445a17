"""Scalar column functions: charges, ids, labels, sequences, alignments, percentages and display forms."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# SAM flag bits.
FLAG_PROPER, FLAG_UNMAPPED, FLAG_MATE_UNMAPPED, FLAG_REVERSE, FLAG_SECONDARY, FLAG_SUPPLEMENTARY = 0x2, 0x4, 0x8, 0x10, 0x100, 0x800


def first_charge(text: Column) -> Column:
    """The first integer of a charge such as `2+`, `3-` or `2+ and 3+`, without its sign; null if there is none."""
    return F.abs(F.regexp_extract(text, r"[-+]?\d+", 0).try_cast("int"))


def precursor_or_median(precursor: Column, mz: Column) -> Column:
    """The precursor m/z; else the median fragment m/z; else 0."""
    n, s = F.size(mz), F.array_sort(mz)
    half = F.floor(n / 2).cast("int")
    median = F.when(n > 0, F.when(n % 2 == 1, F.element_at(s, half + 1)).otherwise((F.element_at(s, F.greatest(half, F.lit(1))) + F.element_at(s, half + 1)) / 2))
    return F.coalesce(precursor, F.when(mz.isNotNull(), median), F.lit(0.0))


def charge_rows(df: DataFrame, charge: str, unknown: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Every row with a charge as it is, those without once for each charge of `unknown`."""
    return df.withColumn(charge, F.explode(F.coalesce(F.when(F.col(charge).isNotNull(), F.array(charge)), F.array(*map(F.lit, unknown)))))


def clean_bases(seq: Column, other: str = "A") -> Column:
    """Upper case, without white space, with everything but A, C, G, T replaced by `other`."""
    return F.regexp_replace(F.upper(F.regexp_replace(seq, r"\s+", "")), "[^ACGT]", other)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def spectrum_key(title: Column) -> Column:
    """`file#S0001` from titles such as `file.0001.0001.2`, `file.index:1` or `dir/file.mzML scan=1`; null without a number."""
    base = F.regexp_replace(F.regexp_replace(title, r"^.*[/\\]", ""), r"(?i)\.(mzml|mzxml|mgf|raw)", "")
    root = F.regexp_replace(F.regexp_extract(base, r"^([A-Za-z0-9_-]+)", 1), r"[_-]", "")
    number = F.coalesce(
        F.nullif(F.regexp_extract(base, r"(?:scan|index)[=:](\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(base, r"\.(\d+)\.\d+(?:\.\d+)?$", 1), F.lit("")), F.nullif(F.regexp_extract(base, r"(\d+)\D*$", 1), F.lit(""))
    )
    return F.when(number.isNotNull(), F.concat(root, F.lit("#S"), F.format_string("%04d", number.cast("long"))))


def universal_id(collection: Column, file: Column, scan: Column) -> Column:
    """`mzspec:<collection>:<file>:scan:<n>`."""
    return F.concat_ws(":", F.lit("mzspec"), collection, file, F.lit("scan"), scan.cast("string"))


def peptide_label(sequence: Column, charge: Column) -> Column:
    """`SEQUENCE/charge` with leucine and isoleucine written alike."""
    return F.concat(F.translate(sequence, "L", "I"), F.lit("/"), charge.cast("string"))


def namespaced_labels(df: DataFrame, label: str, charge: str, order: str, prefix: str, out: str = "label") -> DataFrame:
    """Noise (-1) gets the unique `prefix:noise:<id>`, a cluster `z<charge>:<label>`; null charges count as 0."""
    named = F.concat(F.lit("z"), F.coalesce(F.col(charge), F.lit(0)).cast("string"), F.lit(":"), F.col(label).cast("string"))
    return df.withColumn(out, F.when(F.col(label) == -1, F.concat(F.lit(f"{prefix}:noise:"), F.col(order).cast("string"))).otherwise(named))


def number_or(text: Column, default: Column | None = None) -> Column:
    """A double, or `default` (null) for what isn't a number; NaN counts as none."""
    value = F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))
    return F.coalesce(value, default) if default is not None else value


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; null where whole is 0 or null."""
    return F.when(whole != 0, 100.0 * part / whole)


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def cigar_span(cigar: Column, operators: str) -> Column:
    """The summed lengths of the CIGAR operations named in `operators`; 0 for `*` and empty, null for null."""
    lengths = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    kinds = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.aggregate(F.zip_with(lengths, kinds, lambda n, k: F.when(F.lit(operators).contains(k), n.cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def alignment_span(cigar: Column) -> Column:
    return cigar_span(cigar, "MID=X")


def reference_span(cigar: Column) -> Column:
    return cigar_span(cigar, "MDN=X")


def integer_tag(tags: Column, name: str) -> Column:
    """The integer of a tag such as `NM:i:3`; null where it is missing."""
    return F.regexp_extract(tags, rf"(?:^|\t){name}:i:(-?\d+)", 1).try_cast("int")


def rounded_key(charge: Column, time: Column, mz: Column) -> Column:
    """(charge, time * 100, m/z * 1000), halves to even, as one comparable string; an unknown charge counts as 0, and the key is
    null if time or m/z is null."""
    bar = F.lit("|")
    return F.concat(F.coalesce(charge, F.lit(0)).cast("string"), bar, F.rint(time * 100).cast("long").cast("string"), bar, F.rint(mz * 1000).cast("long").cast("string"))


def humanised_seconds(s: Column) -> Column:
    """Two decimals (halves to even) in seconds, from 60 in minutes, from 3,600 in hours, from 86,400 in days."""
    form = lambda unit, seconds: F.format_string(f"%.2f {unit}", F.bround(s / seconds, 2))
    return F.when(s >= 86_400, form("days", 86_400)).when(s >= 3600, form("h", 3600)).when(s >= 60, form("min", 60)).otherwise(form("s", 1))


def humanised_bytes(b: Column) -> Column:
    """Whole bytes with commas between thousands."""
    return F.format_number(b, 0)


def stream_digest(df: DataFrame, by: list[str], order: str, value: str, out: str = "digest", block: int = 4096) -> DataFrame:
    """SHA-256 of the values in `order`, by group: over the hashes of the values, one a line.

    Groups of any size: the rows are numbered in their order without a window over a group, and a group of more than `block`
    rows is digested block by block, then the digests of its blocks in their order, until one is left.
    """
    from helixlake.operators.ordered import numbered

    hashed = df.select(*by, F.col(order).alias("_o"), F.sha2(F.coalesce(F.col(value).cast("string"), F.lit("")), 256).alias("_h"))
    rows = numbered(hashed, [*(F.col(c) for c in by), F.col("_o"), F.col("_h")], "_i")
    # `by` may be null, which a join on equality would lose
    first = rows.groupBy(*by).agg(F.min("_i").alias("_f"), F.count(F.lit(1)).alias("_n")).toDF(*(f"_k{i}" for i in range(len(by))), "_f", "_n")
    same = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)))
    most = first.agg(F.max("_n")).first()[0] or 0
    state = rows.join(first, same).select(*by, (F.col("_i") - F.col("_f")).alias("_i"), "_h")
    while True:
        state = state.groupBy(*by, F.floor(F.col("_i") / block).alias("_i")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_h"))), lambda x: x["_h"]), "\n"), 256).alias("_h"))
        most = -(-most // block)
        if most <= 1:
            return state.select(*by, F.col("_h").alias(out))


def natural_key(text: Column) -> Column:
    """A key that sorts digit runs by value: runs are padded to 20 digits, letters in lower case."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def renumbered(df: DataFrame, label: str, by: list[str], out: str) -> DataFrame:
    """Clusters renumbered from 0 by descending size (then label) within `by`; noise (-1) stays."""
    sizes = df.where(F.col(label) != -1).groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn(out, F.row_number().over(w.orderBy(F.desc("_n"), label)) - 1).drop("_n")
    return df.join(ranked, [*by, label], "left").withColumn(out, F.coalesce(out, F.lit(-1)))

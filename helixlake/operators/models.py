"""Closed-form cost models: latency, energy and bytes moved, as columns over rows of counts.

All are expressions on counts, so that one row or a billion rows of counts cost the same plan. Presets are plain numbers.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published constants, as they stand. Where two versions are published, both are named.
FILTER_PRESETS = {"document": {"setup_us": 50.0, "service_us": 0.0, "energy_pj": 20.0}, "code": {"setup_us": 0.0, "service_us": 9.193, "energy_pj": 10.52e6}}
GB = 1e9


@dataclass(frozen=True)
class Array:
    """A compute array: dimension, tiles, rows at a time, and its times (ns) and energies (fJ)."""

    dim: int = 2048
    tiles: int = 64
    columns: int = 256
    rows_at_once: int = 2048
    cycle_ns: float = 20.0
    local_ns: float = 10.0
    global_ns: float = 7.0
    restore_ns: float = 50.0
    dac_fj: float = 20.0
    read_fj: float = 2.0
    adc_fj: float = 200.0
    digital_fj: float = 50.0
    restore_fj: float = 39.7
    endurance: float = 1e12

    @property
    def serial(self) -> int:
        return max(1, -(-self.dim // max(1, self.rows_at_once)))


def encoding(queries: Column, batch: int = 32, cycles: int = 100, clock_hz: float = 500e6, energy_pj: float = 50.0) -> dict[str, Column]:
    batches = F.ceil(F.greatest(queries, F.lit(0)) / max(1, batch))
    return {"batches": batches, "seconds": batches * (max(1, cycles) / max(1.0, clock_hz)), "energy_mj": queries * (max(0.0, energy_pj) * 1e-9)}


def array_queries(queries: Column, a: Array = Array()) -> dict[str, Column]:
    """Latency and energy of queries against a full array, restores of the destructive read included."""
    per_ns = a.serial * (a.cycle_ns + a.restore_ns) + a.local_ns + a.global_ns
    columns = a.tiles * a.columns
    per_fj = a.dim * a.dac_fj + columns * (a.dim * (a.read_fj + a.restore_fj) + a.adc_fj + a.digital_fj)
    return {"seconds": queries * (per_ns * 1e-9), "energy_mj": queries * (per_fj * 1e-12), "restore_seconds": queries * (a.serial * a.restore_ns * 1e-9), "endurance_queries": F.lit(a.endurance / a.serial)}


def bucket(size: Column, a: Array = Array()) -> dict[str, Column]:
    """Cost of one bucket's distance matrix; nothing for a bucket of one. Columns beyond the array take more passes."""
    passes = F.greatest(F.lit(1), F.ceil(size / max(1, a.tiles * a.columns)))
    per_ns = passes * (a.serial * (a.cycle_ns + a.restore_ns)) + (a.local_ns + a.global_ns)
    per_fj = a.dim * a.dac_fj + size * (a.dim * (a.read_fj + a.restore_fj) + a.adc_fj + a.digital_fj)
    paid = lambda c: F.when(size > 1, c).otherwise(F.lit(0.0))
    return {"seconds": paid(per_ns * size * 1e-9), "energy_mj": paid(per_fj * size * 1e-12), "restore_seconds": paid(passes * size * (a.serial * a.restore_ns * 1e-9)), "passes": F.when(size > 1, passes).otherwise(0)}


def coarse_filter(rows: Column, metadata_bytes: float = 16.0, payload_bytes: float = 256.0, stream_gbps: float = 8.1, link_gbps: float = 256.0, link_pj_per_bit: float = 0.3, preset: str = "code") -> dict[str, Column]:
    p = FILTER_PRESETS[preset]
    scan, move = rows * (metadata_bytes / (stream_gbps * GB)), rows * (payload_bytes / (min(stream_gbps, link_gbps) * GB))
    service = rows * (p["service_us"] * 1e-6)
    link = rows * (payload_bytes * 8 * link_pj_per_bit * 1e-12)
    return {"scan_seconds": scan, "transfer_seconds": move, "seconds": F.lit(p["setup_us"] * 1e-6) + service + scan + move, "energy_mj": (rows * (p["energy_pj"] * 1e-12) + link) * 1e3}


def link_transfer(rows: Column, bytes_a_row: float = 2048.0, mb_per_s: float = 1600.0, setup_us: float = 50.0) -> dict[str, Column]:
    data = rows * (bytes_a_row / (max(1.0, mb_per_s) * 1e6))
    return {"data_seconds": data, "seconds": data + setup_us * 1e-6}


def transfer(size: Column, gbps: Column, pj_per_bit: Column | float = 0.0) -> dict[str, Column]:
    """Seconds and joules of moving bytes; nothing for no bytes."""
    rate = F.greatest(gbps, F.lit(1e-12)) * GB
    e = pj_per_bit if isinstance(pj_per_bit, Column) else F.lit(float(pj_per_bit))
    return {"seconds": F.when(size > 0, size / rate).otherwise(0.0), "energy_j": F.when(size > 0, size * 8.0 * F.greatest(e, F.lit(0.0)) * 1e-12).otherwise(0.0)}


def segments(df: DataFrame, name: str, size: str, gbps: str, mode: str = "auto", manual_seconds: float = 0.0) -> DataFrame:
    """One row: bytes and seconds of independent links, added up. `manual` takes given seconds, `none` nothing."""
    if mode in ("manual", "none"):
        return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).withColumn("seconds", F.lit(manual_seconds if mode == "manual" else 0.0))
    return df.withColumn("_s", transfer(F.col(size), F.col(gbps))["seconds"]).agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.coalesce(F.sum("_s"), F.lit(0.0)).alias("seconds"))


def cold_warm_links(df: DataFrame, size: str, gbps: str, warm: str, pj_per_byte: float) -> DataFrame:
    """Bytes, latency (ms) and energy (mJ) of all links, and of those that repeat for every batch."""
    ms, mj = F.col(size) / (F.col(gbps) * GB) * 1e3, F.col(size) * (pj_per_byte * 1e-9)
    w = lambda c: F.sum(F.when(F.col(warm), c).otherwise(0.0))
    return df.agg(F.sum(size).alias("cold_bytes"), F.sum(ms).alias("cold_ms"), F.sum(mj).alias("cold_mj"), w(F.col(size)).alias("warm_bytes"), w(ms).alias("warm_ms"), w(mj).alias("warm_mj"))


def search_cost(per_query: DataFrame, candidates: str, dim: int = 8192, columns: int = 16_384, external_gbps: float = 8.1, restore_ns: float = 50.0, restore_fj: float = 39.7) -> DataFrame:
    """One row from candidates per query: comparisons, bytes, time on the link, restore passes, their time and energy."""
    c = F.coalesce(F.col(candidates), F.lit(0))
    t = per_query.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum(c), F.lit(0)).alias("comparisons"), F.coalesce(F.sum(F.ceil(c / max(1, columns))), F.lit(0)).alias("restore_passes"))
    rate = external_gbps * GB
    return t.select(
        "queries", "comparisons", "restore_passes", (F.col("comparisons") * (dim // 8)).alias("compare_bytes"), (F.col("comparisons") * (dim // 8 / rate)).alias("compare_seconds"), (F.col("queries") * (dim // 8 / rate)).alias("broadcast_seconds"),
        (F.col("comparisons") * (4 / rate)).alias("result_seconds"), (F.col("restore_passes") * (restore_ns * 1e-9)).alias("restore_seconds"), (F.col("comparisons") * (dim * restore_fj * 1e-12)).alias("restore_mj"),
    )


def restore_rollup(reads: Column, passes: Column, old_j: Column, link_j: float = 0.0, bits: int = 8192, restore_fj: float = 39.7, restore_ns: float = 50.0, active_w: float = 45.0) -> dict[str, Column]:
    """Energy with restores: the old total, the link, the restored bits, and the active power during the added time."""
    seconds = passes * (restore_ns * 1e-9)
    restore = reads * (bits * restore_fj * 1e-15)
    return {"restore_seconds": seconds, "restore_j": restore, "energy_j": old_j + link_j + restore + seconds * active_w}


def all_pairs_cycles(n: Column) -> Column:
    """The closed form of all-pairs shortest paths: n^3 steps."""
    return n.cast("double") * n * n


def check_capacity(tiles: int, rows: int, columns: int, capacity_bits: int) -> None:
    """Capacity equalities: ValueError where the parts don't make the whole."""
    if tiles * rows * columns != capacity_bits:
        raise ValueError(f"{tiles} * {rows} * {columns} bits are not {capacity_bits}")


def plausible_power(watts: Column, design_w: float, least: float = 60.0) -> Column:
    """A measured power below `least` is replaced by the design power, at least 100 W."""
    return F.when(watts < least, F.lit(max(100.0, design_w))).otherwise(watts)


def movement(cold: Column, warm: Column, moved_before: Column, moved_after: Column) -> dict[str, Column]:
    """Movement time and fraction, and the reduction of bytes in percent (null where nothing moved before)."""
    t = F.greatest(cold - warm, F.lit(0.0))
    return {"movement": t, "fraction": F.when(cold > 0, t / cold), "reduction_percent": F.when(moved_before > 0, 100.0 * (1 - moved_after / moved_before))}


def scaled(seconds: Column, source_clock: float, target_clock: float, source_bandwidth: float, target_bandwidth: float, bound: Column) -> Column:
    """A phase on another machine: `compute` scales with the clock, `memory` with the bandwidth, else unchanged."""
    return F.when(bound == "compute", seconds * (source_clock / target_clock)).when(bound == "memory", seconds * (source_bandwidth / target_bandwidth)).otherwise(seconds)


def extrapolated(seconds: Column, measured: Column, wanted: Column) -> Column:
    """Linear in bytes, bases or reads; null where nothing was measured."""
    return F.when(measured > 0, seconds * wanted / measured)


def combined(phases: list[Column], how: str) -> Column:
    """`overlap`: the longest phase; `additive`: their sum."""
    if how == "overlap":
        return F.greatest(*phases) if len(phases) > 1 else phases[0]
    total = phases[0]
    for p in phases[1:]:
        total = total + p
    return total


def fastq_bytes(bases: Column, records: Column) -> Column:
    """The least a FASTQ file can have: bases and qualities, and six bytes of marks and line ends a record."""
    return 2 * bases + 6 * records


def total_latency(df: DataFrame, stage: str, seconds: str, expected: list[str]) -> DataFrame:
    """One row: the sum over stages, and the missing stages; the sum is null if one is missing."""
    have = df.where(F.col(seconds).isNotNull()).agg(F.sum(seconds).alias("s"), F.collect_set(stage).alias("have"))
    missing = F.array_except(F.array(*map(F.lit, expected)), F.col("have"))
    return have.select(F.when(F.size(missing) == 0, F.col("s")).alias("total_seconds"), F.array_sort(missing).alias("missing"))


def routed_experts(logits: Column, k: int) -> Column:
    """The k likeliest experts of a softmax router with renormalised weights: array<struct<expert, weight>>, best first."""
    top = F.array_max(logits)
    power = F.transform(logits, lambda x, i: F.struct((-F.exp(x - top)).alias("p"), i.alias("expert")))
    best = F.slice(F.array_sort(power), 1, k)
    total = F.aggregate(best, F.lit(0.0), lambda s, x: s - x["p"])
    return F.transform(best, lambda x: F.struct(x["expert"].alias("expert"), (-x["p"] / total).alias("weight")))

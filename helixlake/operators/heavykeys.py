"""Problem 4: per-key results where a few keys hold most records, by eager aggregation through joins."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.plans.lineage import materialise


def eager_join_sums(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    by: list[str],
    left_sums: dict[str, Column] | None = None,
    right_sums: dict[str, Column] | None = None,
    how: str = "inner",
    left_count: Column | None = None,
) -> DataFrame:
    """The result of joining `left` and `right` on `on` and grouping by `by`, without ever forming the joined rows.

    Both inputs are first grouped by the join key and the grouping columns they own, to a count and partial sums; Spark
    combines these before the shuffle, so a key that holds a third of all rows arrives as one row a task. The compact
    states are joined; a state of n left rows meeting one of m right rows stands for n * m joined rows, so counts are
    multiplied and a sum of one side is scaled by the other side's count. Then the states are rolled up to `by`.

    Rows of `left` that are states already count as often as `left_count` says.

    Gives `by`, `n` (joined rows) and the named sums. Null join keys match nothing (as in SQL); with how="left" an
    unmatched left state counts its rows once, and sums of the right side are null there. Equal column names on both
    sides other than `on` must not occur in `by`; other columns of the inputs are dropped first. Empty inputs give no rows.
    """
    left_sums, right_sums = left_sums or {}, right_sums or {}
    own = [c for c in by if c not in on and c in left.columns]
    other = [c for c in by if c not in on and c not in left.columns]
    a = left.groupBy(*on, *own).agg((F.count(F.lit(1)) if left_count is None else F.sum(left_count)).alias("_n"), *(F.sum(e).alias(f"_l_{c}") for c, e in left_sums.items()))
    b = right.groupBy(*on, *other).agg(F.count(F.lit(1)).alias("_m"), *(F.sum(e).alias(f"_r_{c}") for c, e in right_sums.items()))
    joined = a.join(b, on, how)
    m = F.coalesce("_m", F.lit(1))
    return joined.groupBy(*by).agg(
        F.sum(F.col("_n") * m).alias("n"),
        *(F.sum(F.col(f"_l_{c}") * m).alias(c) for c in left_sums),
        *(F.sum(F.col(f"_r_{c}") * F.col("_n")).alias(c) for c in right_sums),
    )


def canonical_kmer(kmer: Column, k: int = 15) -> Column:
    """Trimmed, in upper case, the smaller of the k-mer and its reverse complement; null unless k letters of ACGT."""
    up = F.upper(F.regexp_replace(kmer, r"^\s+|\s+$", ""))
    return F.when(up.rlike(f"^[ACGT]{{{k}}}$"), F.least(up, F.reverse(F.translate(up, "ACGT", "TGCA"))))


def canonical_node(node: Column) -> Column:
    """Without white space and leading > or <; null if nothing or * is left."""
    bare = F.regexp_replace(F.regexp_replace(node, r"\s+", ""), "^[<>]+", "")
    return F.when((bare != "") & (bare != "*"), bare)


def written_counts(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(key_field, written, n): the number of distinct ids for every key as it is written, and their total under a null field.

    The table is read once. An id counts once, with its smallest written key; what leaves a task is one row for each key it
    met, so a key that holds a third of all rows reaches the shuffle as one state a task. The states are written to the shared
    folder, for they are used several times and far fewer than the rows.
    """
    flat = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), *(F.col(c).cast("string").alias(f"_k{i}") for i, c in enumerate(columns)))
    ids = flat.groupBy("_id").agg(*(F.min(f"_k{i}").alias(f"_k{i}") for i in range(len(columns))))
    keys = [F.struct(F.lit(c).alias("key_field"), F.col(f"_k{i}").alias("written")) for i, c in enumerate(columns)]
    keys.append(F.struct(F.lit(None).cast("string").alias("key_field"), F.lit("").alias("written")))
    states = ids.select(F.explode(F.array(*keys)).alias("_s")).select("_s.*").where("written IS NOT NULL")
    return materialise(states.groupBy("key_field", "written").agg(F.count(F.lit(1)).alias("n")), "written-keys")


def key_counts(df: DataFrame, id_col: str, forms: dict[str, Callable[[Column], Column]], counted: DataFrame | None = None) -> DataFrame:
    """(key_field, key_value, n): the number of distinct ids for every key of every field, whatever the skew of the keys.

    `forms` maps a column to the function that gives its canonical form (null = no key). The first input of the eager join
    is the ids grouped by key as written (`written_counts`, given as `counted` if it is there already), the second the
    spellings met, each with its canonical form; the counts are multiplied and rolled up to canonical keys. So forms are
    computed once a spelling.

    Rows with a null id, null keys and keys without a canonical form are left out. A re-delivered id counts once, with its
    smallest written key. Further columns, of any name, are dropped at the start. An empty input gives no rows.
    """
    left = (written_counts(df, id_col, list(forms)) if counted is None else counted).where("key_field IS NOT NULL")
    canon = reduce(lambda e, c: e.when(F.col("key_field") == c, forms[c](F.col("written"))), list(forms)[1:], F.when(F.col("key_field") == list(forms)[0], forms[list(forms)[0]](F.col("written"))))
    right = left.select("key_field", "written", canon.alias("key_value")).where(F.col("key_value").isNotNull())
    return eager_join_sums(left, right, ["key_field", "written"], ["key_field", "key_value"], left_count=F.col("n"))


def heavy_keys(counts: DataFrame, total: int, share: float = 0.02) -> DataFrame:
    """The keys of `key_counts` that hold at least `share` of `total` ids. No ids: no rows."""
    return counts.where(F.col("n") >= F.lit(share) * F.lit(total)) if total else counts.limit(0)

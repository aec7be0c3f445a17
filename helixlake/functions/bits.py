"""Column functions on bit vectors: sign packing, popcounts and Hamming distances, all in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_bits(vector: Column, tie: int = 1) -> Column:
    """array<int> of 1 for positive and 0 for negative components; a zero gives `tie`."""
    return F.transform(vector, lambda x: F.when(x > 0, 1).when(x < 0, 0).otherwise(tie))


def pack_bits(bits: Column, n: int) -> Column:
    """n <= 63 bits in one long, the first bit lowest."""
    if not 0 < n <= 63:
        raise ValueError("63 bits at most")
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.call_function("shiftleft", F.get(bits, i).cast("long"), i)))


def pack_words(bits: Column, n: int) -> Column:
    """n bits in array<long> of 32-bit words, the first bit of each word highest."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(-(-n // 32) - 1)),
        lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, i: s * 2 + F.coalesce(F.get(bits, (w * 32 + i).cast("int")), F.lit(0))),
    )


def words(packed: Column, n_bytes: int) -> Column:
    """A packed binary vector as array<long>; the last word may hold fewer bytes."""
    starts = range(1, n_bytes + 1, 7)
    return F.array(*(F.conv(F.hex(F.substring(packed, s, min(7, n_bytes - s + 1))), 16, 10).cast("long") for s in starts))


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of two equally long arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_from_dot(a: Column, b: Column, n: int) -> Column:
    """(n - a.b) / 2 of two vectors of +1 and -1."""
    return ((F.lit(n) - F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("int"), lambda s, x: s + x.cast("int"))) / 2).cast("int")

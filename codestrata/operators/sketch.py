"""128-bit Bloom filters as sorted arrays of set bits."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MULTIPLIERS = (31, 37, 41)


def bits(text: Column) -> Column:
    """The three bits of a string: polynomial hashes modulo 128, which 2^64 arithmetic does not change."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    one = lambda m: F.aggregate(chars, F.lit(0), lambda h, c: (h * m + F.ascii(c)) % 128)
    return F.array_sort(F.array_distinct(F.array(*[one(m) for m in MULTIPLIERS])))


def number_bits(value: Column) -> Column:
    one = lambda m: ((value.cast("long") * m + 0x9E3779B9) % 128).cast("int")
    return F.array_sort(F.array_distinct(F.array(*[one(m) for m in MULTIPLIERS])))


def union(bit_lists: Column) -> Column:
    """Aggregate: the filter that holds every member of the group."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(bit_lists))))


def might_contain(filter_: Column, text: Column) -> Column:
    return F.forall(bits(text), lambda b: F.array_contains(filter_, b))


def similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / most)

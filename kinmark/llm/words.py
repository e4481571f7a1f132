"""The words of a name, in the one form in which names are compared, and order-free fingerprints of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookalike import plain_form

LETTER = r"\p{L}\p{Nd}"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: filters and projections on it would else be merged and repeat the work."""
    return df.withColumn(name, F.explode(F.array(value)))


def normal_text(string: Column | str) -> Column:
    """P2 form, lower case, dots and apostrophes inside words dropped, one space between words; '' where no word is left."""
    low = F.lower(plain_form(string))
    marked = low.contains(".") | low.contains("'") | low.contains("’")
    joined = F.when(marked, F.regexp_replace(low, rf"(?<=[{LETTER}])[.'’](?=[{LETTER}])", "")).otherwise(low)
    return F.trim(F.regexp_replace(joined, rf"[^{LETTER}]+", " "))


def multiset_hash(words: Column, seed: int) -> Column:
    """Sum of the hashes of words, or of (field, value) pairs, modulo 2^64, each hashed with the seed: any order gives the same."""
    # in two halves of 32 bits, since sums of LONGs raise an error on overflow
    h = lambda w: F.xxhash64(F.lit("word"), w, F.lit(seed))
    low = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: (a + h(w).bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseAND(F.lit(0x7FFFFFFFFFFFFF)))
    high = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: (a + F.shiftrightunsigned(h(w), 32)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFF)))
    return F.xxhash64(low, high)


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same words equally often, without sorting."""
    times = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    return (F.size(a) == F.size(b)) & F.forall(F.array_distinct(a), lambda w: times(a, w) == times(b, w))

"""Pairs worth a look: those whose union would touch most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SORTABLE = ("impact", "score", "loss")


def without_pairs(pairs: DataFrame, skip: DataFrame) -> DataFrame:
    """pairs without those in skip (string0, string1), in either order."""
    key = lambda df: df.select(F.least("string0", "string1").alias("_a"), F.greatest("string0", "string1").alias("_b")).distinct()
    named = pairs.withColumns({"_a": F.least("string0", "string1"), "_b": F.greatest("string0", "string1")})
    return named.join(key(skip), ["_a", "_b"], "left_anti").drop("_a", "_b")


def top_scored_pairs(scored: DataFrame, matches: DataFrame, n: int = 10_000, by_group: bool = True, sort_by: tuple[str, ...] = ("impact", "score"), ascending: bool = False, skip: DataFrame | None = None) -> DataFrame:
    """The first n pairs of different groups by impact (the groups' numbers of strings multiplied) and score, ties by strings.

    by_group keeps the best pair of each two groups, and leaves out all pairs of two groups of which skip has one. n is the
    report's length.
    """
    bad = [c for c in sort_by if c not in SORTABLE]
    if bad:
        raise ValueError(f"pairs can't be sorted by {bad}")
    rows = scored.where("group0 != group1")
    if skip is not None and by_group:
        of = lambda i: matches.select(F.col("string").alias(f"string{i}"), F.col("group").alias(f"group{i}"))
        gone = skip.select("string0", "string1").join(of(0), "string0").join(of(1), "string1").select(F.least("group0", "group1").alias("_a"), F.greatest("group0", "group1").alias("_b")).distinct()
        rows = rows.withColumns({"_a": F.least("group0", "group1"), "_b": F.greatest("group0", "group1")}).join(gone, ["_a", "_b"], "left_anti").drop("_a", "_b")
    elif skip is not None:
        rows = without_pairs(rows, skip)
    sizes = matches.groupBy("group").agg(F.count("*").alias("k"))
    g = lambda i: sizes.select(F.col("group").alias(f"group{i}"), F.col("k").alias(f"k{i}"))
    rows = rows.join(g(0), "group0").join(g(1), "group1").withColumn("impact", F.col("k0") * F.col("k1"))
    rounded = {"score": F.round("score", 9), "loss": F.round("loss", 9), "impact": F.col("impact")}
    order = [rounded[c].asc() if ascending else rounded[c].desc() for c in sort_by] + [F.col("string0"), F.col("string1")]
    if by_group:
        first = W.partitionBy(F.least("group0", "group1"), F.greatest("group0", "group1")).orderBy(*order)
        rows = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1)
    return rows.orderBy(*order).limit(n).select("string0", "string1", "group0", "group1", "score", "loss", "impact")

"""Merging two tables through a partition of their strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_each

HOW = ("inner", "left", "right", "outer")


def merge_tables(
    left: DataFrame, right: DataFrame, matches: DataFrame, how: str = "inner", on: str | None = None, left_on: str | None = None, right_on: str | None = None,
    group_column: str = "match_group", suffixes: tuple[str, str] = ("_x", "_y"), match_nulls: bool = True,
) -> DataFrame:
    """Rows of both tables whose strings are in the same group, with the left row's group.

    A string that the partition doesn't know has a null group; null groups match one another unless match_nulls is False, and
    rows of the right table only have a null group. Groups of very many rows, and the null group, are parted over tasks.
    Columns of both sides keep apart by suffixes. The partition is joined by string, so either side may be of any size. A missing key, an unknown kind of join and a taken group column are ValueErrors.
    """
    left_on, right_on = left_on or on, right_on or on
    if not left_on or not right_on:
        raise ValueError("name the key columns by on, or by left_on and right_on")
    if how not in HOW:
        raise ValueError(f"how is one of {', '.join(HOW)}")
    if group_column in left.columns or group_column in right.columns:
        raise ValueError(f"there is a column {group_column!r} already; name another group_column")
    clash = set(left.columns) & set(right.columns)
    names = matches.select(F.col("string").alias("_s"), F.col("group").alias("_g"))
    sides = []
    for df, key, suffix in ((left, left_on, suffixes[0]), (right, right_on, suffixes[1])):
        mapped = join_each(df.withColumn("_s", df[key]), names, ["_s"], "left").drop("_s")
        sides.append(mapped.withColumnsRenamed({c: c + suffix for c in clash}))
    # a null group is a key of its own: one for both sides, or one for each
    side = lambda df, mark: df.withColumns({"_k": F.when(F.col("_g").isNotNull(), 0).otherwise(1 if match_nulls else mark), "_v": F.coalesce("_g", F.lit(""))})
    a, b = side(sides[0], 1).withColumnRenamed("_g", group_column), side(sides[1], 2).drop("_g")
    keys = ["_k", "_v"]
    if how in ("inner", "left"):
        return join_each(a, b, keys, how).drop(*keys)
    met = join_each(a, b, keys, "inner" if how == "right" else "left")
    alone = b.join(a.select(*keys).distinct(), keys, "left_anti")
    return met.unionByName(alone, allowMissingColumns=True).drop(*keys)

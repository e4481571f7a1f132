"""Joins and ranks that survive a key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

#: Rows of one key that a task may hold. Keys with more are at most 1 in TASK_ROWS rows, so their list may be broadcast.
TASK_ROWS = 1_000_000


def join_unique(big: DataFrame, small: DataFrame, keys: list[str], weight: str, how: str = "inner", scratch: Scratch | None = None) -> DataFrame:
    """Join of big with small, which has one row a key and in `weight` the number of big's rows with it; how is inner or left.

    small is written once. A key of more than TASK_ROWS rows is parted: its row in small is repeated once for each TASK_ROWS
    of its rows, and each of its rows in big, by a hash of the row, goes to one of these. Such keys are the only ones that are
    broadcast: at most a millionth of big's rows, with their number of parts. Nulls in keys join nothing.
    """
    small = (scratch or Scratch(big.sparkSession)).write(small)
    hot = small.where(F.col(weight) > TASK_ROWS).select(*keys, F.ceil(F.col(weight) / TASK_ROWS).cast("int").alias("_parts"))
    if hot.isEmpty():
        return big.join(small, keys, how)
    parts = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(weight) / TASK_ROWS).cast("int"), F.lit(1)) - 1)))
    at = F.coalesce(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in big.columns)), F.col("_parts")).cast("int"), F.lit(0))
    marked = big.join(F.broadcast(hot), keys, "left").withColumn("_part", at).drop("_parts")
    return marked.join(parts, [*keys, "_part"], how).drop("_part")


def join_each(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of big with small, inner, left or left_anti, where nothing is known of either's keys.

    big's rows are counted by key, by partial sums of the keys alone. A key of more than TASK_ROWS of them is parted as in
    join_unique; small's rows of such keys, and no others, are repeated once for each part.
    """
    scratch = Scratch(big.sparkSession)
    hot = big.groupBy(*keys).agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("_parts")).where("_parts > 1")
    hot = scratch.write(hot.dropna(subset=keys))
    if hot.isEmpty():
        return big.join(small, keys, how)
    at = F.coalesce(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in big.columns)), F.col("_parts")).cast("int"), F.lit(0))
    marked = big.join(F.broadcast(hot), keys, "left").withColumn("_part", at).drop("_parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    parts = small.join(F.broadcast(hot), keys, "left").withColumn("_part", every).drop("_parts")
    return marked.join(parts, [*keys, "_part"], how).drop("_part")


def ranks(df: DataFrame, by: list[str], order: Column, size: Column | None = None, most: int = 0, out: str = "rank", seed: int = 17) -> DataFrame:
    """Adds, within each `by`, the running sum of size (1 by default) over the rows before, in the order of hash buckets.

    `order` is a LONG that is unique for a row (an id): its hash spreads the rows of one `by` over buckets, sums of buckets
    are made by partial aggregation, and only rows of one bucket are ever sorted together. most is the number of rows of the
    largest `by`, where it is known: buckets hold a hundred thousand of them at most on average. The order is the hash's, so
    it is random with respect to the data but the same in each run with the same seed.
    """
    from pyspark.sql import Window as W

    buckets = max(1024, most // 100_000)
    size = F.lit(1).cast("long") if size is None else size.cast("long")
    rows = df.withColumns({"_at": F.xxhash64(order, F.lit(seed)), "_size": size})
    rows = rows.withColumn("_bucket", F.pmod("_at", F.lit(buckets)))
    sums = rows.groupBy(*by, "_bucket").agg(F.sum("_size").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))).select(
        *by, "_bucket", F.coalesce("_before", F.lit(0)).alias("_before")
    )
    inner = W.partitionBy(*by, "_bucket").orderBy("_at", order).rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    return inside.join(before, [*by, "_bucket"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_at", "_size", "_bucket", "_before", "_inside")

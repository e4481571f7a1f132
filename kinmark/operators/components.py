"""Connected components of string links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_each, join_unique
from ..plans.storage import Scratch

SEEDS = 8


def _stars(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """One large-star and one small-star step over edges (u, v), u > v: neighbours are handed to the smallest of all."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    large = join_unique(both, least, ["u"], "n", scratch=scratch).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    large = scratch.write(large)
    small = join_unique(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), ["u"], "n", scratch=scratch)
    small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
    return small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(member, root) of every string that links (a, b) name; root is one member, the same for all that are linked.

    Nulls link nothing, though the other end still is a member; a string linked with itself only is its own root. Strings are
    64-bit hashes meanwhile; should two share one, another seed is taken. Each round's edges go to the shared folder.
    """
    spark = links.sparkSession
    scratch = Scratch(spark)
    pairs = scratch.write(links.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct())
    for seed in range(SEEDS):
        named = lambda c: F.xxhash64(F.col(c), F.lit(seed))  # noqa: B023, E731
        members = pairs.select(F.explode(F.array("a", "b")).alias("member")).where("member is not null").distinct()
        members = scratch.write(members.withColumn("id", F.xxhash64("member", F.lit(seed))))
        if members.groupBy("id").count().where("count > 1").isEmpty():
            break
        scratch.drop(members)
    else:
        raise RuntimeError("hashes of strings collide under every seed")
    ids = pairs.where("a is not null and b is not null").select(named("a").alias("x"), named("b").alias("y")).where("x != y")
    edges = scratch.write(ids.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    state = None
    while True:
        after = scratch.write(_stars(edges, scratch))
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = after
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("r"))
    found = members.join(roots, "id", "left").select("member", F.coalesce("r", "id").alias("id"))
    return join_each(found, members.select("id", F.col("member").alias("root")), ["id"]).select("member", "root")

import pytest
from pyspark.sql import functions as F

from kinmark.operators.components import components
from kinmark.plans import skew


@pytest.mark.parametrize("rows", [10, 1_000_000])
def test_join_with_many_hot_keys(spark, monkeypatch, rows):
    monkeypatch.setattr(skew, "TASK_ROWS", rows)
    big = spark.range(9000).select("id", F.when(F.col("id") % 10 == 9, None).otherwise(F.pmod(F.col("id"), F.lit(250))).alias("k"))
    big = big.unionByName(spark.range(9000, 12000).select("id", F.lit(1000).cast("long").alias("k")))
    small = big.where("k is not null and k != 3").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    plain = sorted(map(tuple, big.join(small, "k").select("id", "k", "n", "least").collect()))
    assert sorted(map(tuple, skew.join_unique(big, small, ["k"], "n").select("id", "k", "n", "least").collect())) == plain
    left = skew.join_unique(big, small, ["k"], "n", "left")
    assert left.count() == 12000 and left.where("n is null").count() == 12000 - len(plain)


def test_ranks_are_running_sums(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("size"))
    rows = skew.ranks(df, ["g"], F.col("id"), F.col("size"), most=10**9).collect()
    for g in range(3):
        mine = sorted((r["rank"], r["rank"] + r["size"]) for r in rows if r["g"] == g)
        assert mine[0][0] == 0 and all(a[1] == b[0] for a, b in zip(mine, mine[1:], strict=False))


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    links = spark.range(3000).select(F.lit("hub").alias("a"), F.concat(F.lit("leaf"), F.col("id")).alias("b"))
    links = links.unionByName(spark.range(40).select(F.concat(F.lit("c"), F.col("id")).alias("a"), F.concat(F.lit("c"), F.col("id") + 1).alias("b")))
    got = components(links, "a", "b").collect()
    assert len(got) == 3042 and len({r["root"] for r in got if r["member"][0] != "c"}) == 1 and len({r["root"] for r in got}) == 2

"""Problem 3: one identifier for all that pairwise matches link, by Borůvka rounds over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_unique
from ..plans.storage import Scratch

SEEDS = 8


def contract(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of every vertex of edges (u, v LONG), the same root for all vertices of a component.

    A round: each component takes its smallest outgoing edge; with edges ordered by their smaller, then their larger end that
    is the edge to its smallest neighbour, and such choices make trees whose only cycles are two that chose the same edge.
    Pointers are doubled twice (four steps up), edges get the new names, loops and repeats go. Trees deeper than four are
    still joined by their own edges and collapse further in the next round. Components at least halve, so rounds are
    logarithmic; each round's tables go to the shared folder and the ones before are deleted.
    """
    edges = scratch.write(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("to")), F.struct(F.col("v").alias("id"), F.col("u").alias("to")))).alias("e"))
        chosen = scratch.write(ends.groupBy("e.id").agg(F.min("e.to").alias("to")))
        up = chosen.alias("a").join(chosen.alias("b"), F.col("a.to") == F.col("b.id"))
        # two that chose each other: the smaller is the root
        one = up.select("a.id", F.when(F.col("b.to") == F.col("a.id"), F.least("a.id", "a.to")).otherwise(F.col("b.to")).alias("to"))
        one = scratch.write(one)
        two = scratch.write(one.alias("a").join(one.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", F.col("b.to").alias("to")))
        renamed = edges.join(two.select(F.col("id").alias("u"), F.col("to").alias("x")), "u").join(two.select(F.col("id").alias("v"), F.col("to").alias("y")), "v")
        after = scratch.write(renamed.where("x != y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        scratch.drop(edges, chosen, one)
        edges = after
        rounds.append(two)
    if not rounds:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    roots = rounds.pop()
    while rounds:
        earlier = rounds.pop()
        joined = earlier.alias("a").join(roots.alias("b"), F.col("a.to") == F.col("b.id"), "left")
        later = scratch.write(joined.select("a.id", F.coalesce("b.to", "a.to").alias("to")))
        scratch.drop(earlier, roots)
        roots = later
    return roots.select("id", F.col("to").alias("root"))


def linked_strings(links: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(string, rep): each string that is linked with another one, and the first string, by code point, of all it is linked with.

    pairs are the columns that a row links, by default string0 with string1 and each with its group's label. Nulls and a
    string paired with itself link nothing; repeated and reversed pairs count once; an empty string is a string. Strings are
    64-bit hashes while components are made; should two strings share one, another seed is taken, so results are exact.
    """
    pairs = pairs or [("string0", "string1"), ("string0", "group0"), ("string1", "group1")]
    scratch = Scratch(links.sparkSession)
    ends = F.array(*(F.struct(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for a, b in pairs))
    both = links.select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a is not null and b is not null and a != b")
    for seed in range(SEEDS):
        named = lambda c: F.xxhash64(c, F.lit(seed))  # noqa: B023, E731
        strings = both.select(F.explode(F.array("a", "b")).alias("string")).groupBy(named("string").alias("id"), "string").agg(F.lit(1).alias("n")).drop("n")
        strings = scratch.write(strings)
        twice = strings.groupBy("id").count().where("count > 1")
        if twice.isEmpty():
            break
        scratch.drop(strings)
    else:
        raise RuntimeError("hashes of strings collide under every seed")
    roots = contract(both.select(named("a").alias("u"), named("b").alias("v")), scratch)
    members = scratch.write(strings.join(roots, "id").select("string", "root"))
    scratch.drop(strings)
    reps = members.groupBy("root").agg(F.min("string").alias("rep"), F.count("*").alias("n"))
    return join_unique(members, reps, ["root"], "n").select("string", "rep")

"""Problem 9: mixing sources to target weights, by min-cost flow from membership patterns to source quotas.

A document may belong to several sources (it was delivered by each). Documents of the same set of sources are alike, so flow
runs from the patterns, at most 2^sources of them, to the sources: a pattern's first use costs nothing, each repetition more
than the one before. Flows are amounts of tokens; documents then stand in seeded order on a line as long as their pattern's
tokens, and each takes part wherever its middle falls into the stretch that the flow gave to a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import ranks
from ..plans.storage import Scratch
from .tokens import VOCABULARY, token_count

EPS = 1e-6


def min_cost_flow(patterns: dict[tuple[str, ...], float], quotas: dict[str, float], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], float]:
    """Tokens from each pattern to each of its sources, as much as quotas and repeats allow, at the least cost of repetition.

    Repetition k of a pattern costs k for each token. Successive shortest paths over the few nodes of patterns and sources.
    """
    nodes = ["S", "T", *patterns, *quotas]
    index = {x: i for i, x in enumerate(nodes)}
    arcs: list[list] = []  # to, capacity, cost; the reverse arc is arc ^ 1
    out: list[list[int]] = [[] for _ in nodes]

    def arc(a, b, capacity: float, cost: float) -> int:
        out[index[a]].append(len(arcs))
        arcs.append([index[b], capacity, cost])
        out[index[b]].append(len(arcs))
        arcs.append([index[a], 0.0, -cost])
        return len(arcs) - 2

    carried = {}
    for p, mass in patterns.items():
        for k in range(min(repeats[s] for s in p)):
            arc("S", p, mass, float(k))
        for s in p:
            carried[p, s] = arc(p, s, mass * repeats[s], 0.0)
    for s, q in quotas.items():
        arc(s, "T", q, 0.0)
    while True:
        cost, via = [float("inf")] * len(nodes), [-1] * len(nodes)
        cost[0] = 0.0
        changed = True
        while changed:
            changed = False
            for a in range(len(nodes)):
                for i in out[a]:
                    b, capacity, c = arcs[i]
                    if capacity > EPS and cost[a] + c < cost[b] - 1e-9:
                        cost[b], via[b], changed = cost[a] + c, i, True
        if cost[1] == float("inf"):
            return {k: arcs[i ^ 1][1] for k, i in carried.items()}
        path, at = [], 1
        while at:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        push = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= push
            arcs[i ^ 1][1] += push


def reachable_total(patterns: dict[tuple[str, ...], float], shares: dict[str, float], repeats: dict[str, int]) -> float:
    """The largest total at which every source that has any documents gets its share, by bisection over flows."""
    have = {s: shares[s] for s in shares if any(s in p for p in patterns) and shares[s] > 0}
    if not have:
        return 0.0
    low, high = 0.0, min(sum(m * repeats[s] for p, m in patterns.items() if s in p) / share for s, share in have.items())
    if _meets(patterns, have, repeats, high):
        return high
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if _meets(patterns, have, repeats, mid) else (low, mid)
    return low


def _meets(patterns, have: dict[str, float], repeats: dict[str, int], total: float) -> bool:
    flow = min_cost_flow(patterns, {s: share * total for s, share in have.items()}, repeats)
    return sum(flow.values()) >= sum(have.values()) * total * (1 - 1e-9)


def mixed_documents(
    documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 42, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key_col: str = "message_id",
    exact_shares: bool = False,
) -> DataFrame:
    """(id, source, uses, tokens): the documents of the mix, each with the source it counts for and how often it is used.

    Rows with equal key are one document, delivered by each row's source; for a source its smallest id stands; a row without a
    key is a document by itself. Texts that are null or empty and sources without a target take no part. total_tokens is by
    default the number of tokens at hand: a source that can't fill its share of that, repetitions included, gives all it has,
    and the others keep their target shares to one another. With exact_shares it is the largest total at which every source
    that has documents gets its share, so the scarcest one decides. A source that has documents and a share gets one at least;
    otherwise amounts are met to within a document for each set of sources that shares documents.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("target_share > 0 AND max_repeats > 0").collect()}
    mine = documents.where(F.col(source_col).isin(sorted(wanted)) & (F.col(text_col) != ""))
    own_key = F.coalesce(F.col(key_col).cast("string"), F.concat(F.lit("\0"), F.col(id_col).cast("string")))
    sized = mine.select(own_key.alias("key"), F.col(source_col).alias("source"), F.col(id_col).cast("long").alias("id"), token_count(F.col(text_col), vocabulary).alias("tokens"))
    sized = scratch.write(sized)
    stands = sized.groupBy("key", "source").agg(F.min("id").alias("id"), F.min_by("tokens", "id").alias("tokens"))
    documents_of = stands.groupBy("key").agg(
        F.array_sort(F.collect_list("source")).alias("pattern"), F.min("id").alias("unit"), F.max("tokens").alias("mass"), F.collect_list(F.struct("source", "id", "tokens")).alias("each")
    )  # lists of at most as many entries as there are sources
    units = scratch.write(documents_of)
    scratch.drop(sized)
    sums = units.groupBy("pattern").agg(F.sum("mass").alias("mass"), F.count("*").alias("n")).collect()
    patterns = {tuple(r["pattern"]): float(r["mass"]) for r in sums}
    shares, repeats = {s: w[0] for s, w in wanted.items()}, {s: w[1] for s, w in wanted.items()}
    total = reachable_total(patterns, shares, repeats) if exact_shares else sum(patterns.values()) / sum(shares.values()) if patterns else 0.0
    total = total if total_tokens is None else float(total_tokens)
    flow = min_cost_flow(patterns, {s: share * total for s, share in shares.items()}, repeats) if patterns else {}
    rows = []
    for p, mass in patterns.items():
        at = 0.0
        for s in p:
            if flow[p, s] > EPS:
                rows.append((list(p), s, at, at + flow[p, s], mass))
                at += flow[p, s]
    # one row for each pattern and source of it
    stretch = F.broadcast(spark.createDataFrame(rows, "pattern array<string>, source string, begin double, finish double, around double"))
    placed = ranks(units, ["pattern"], F.col("unit"), F.col("mass"), most=max((r["n"] for r in sums), default=0), out="place", seed=seed)
    used = placed.join(stretch, "pattern")
    # the line is wound around its pattern's tokens: a place is met once in each round that the stretch covers
    middle = F.col("place") + F.col("mass") / 2
    times = F.ceil((F.col("finish") - middle) / F.col("around")) - F.ceil((F.col("begin") - middle) / F.col("around"))
    used = used.withColumn("uses", F.greatest(times, F.lit(0))).where("uses > 0").select("unit", "pattern", "each", "source", "uses")
    used = scratch.write(used)
    # stretches that are shorter than a document may hold no middle: a source left empty gets its first free document
    empty = sorted({s for _, s, *_ in rows} - {r["source"] for r in used.select("source").distinct().collect()})
    if empty:
        most = F.create_map(*(F.lit(x) for s, n in repeats.items() for x in (s, n)))
        free = units.join(used.groupBy("unit").agg(F.sum("uses").alias("u")), "unit", "left").where(F.coalesce("u", F.lit(0)) < F.array_min(F.transform("pattern", lambda s: F.element_at(most, s))))
        free = free.select("unit", "pattern", "each", F.explode(F.array_intersect("pattern", F.array(*map(F.lit, empty)))).alias("source"))
        first = free.groupBy("source").agg(F.min_by(F.struct("unit", "pattern", "each"), F.struct(F.xxhash64("unit", F.lit(seed)), F.col("unit"))).alias("b"))
        used = used.unionByName(first.select("b.*", "source", F.lit(1).cast("long").alias("uses")))
    mine = F.filter("each", lambda e: e["source"] == F.col("source"))[0]
    return used.select(mine["id"].alias(id_col), "source", "uses", mine["tokens"].alias("tokens"))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, most_uses, tokens, reached_share) for each target."""
    sums = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens"))
    whole = mixed.agg(F.sum(F.col("uses") * F.col("tokens")).alias("whole"))
    rows = targets.join(F.broadcast(sums), "source", "left").join(F.broadcast(whole))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("source", "target_share", "max_repeats", zero("documents").alias("documents"), zero("most_uses").alias("most_uses"), zero("tokens").alias("tokens"), F.round(F.coalesce(zero("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("reached_share"))

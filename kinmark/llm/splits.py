"""Problem 4: splits that keep related records together, by hooking and shortcutting over parent tables and subset-sum bitsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_each, join_unique, ranks
from ..plans.storage import Scratch
from .copies import fingerprints

SEEDS = 8
#: Units above 1/BIG of all rows are placed one by one, RESERVE units of each size up to SMALL are left for the exact step.
BIG, SMALL, RESERVE = 1000, 64, 64
#: Sums of three or more splits that are looked through jointly at most.
STATES = 300_000


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) for the vertices of edges (u, v LONG); root is the smallest id of the component.

    Every vertex has a parent, itself at first. A round hooks: of each edge's two parents the larger one takes the smaller as
    its parent; and shortcuts: every parent is replaced by its parent. Both only lower parents, inside a component, until no
    edge joins two parents and no parent has another one.
    """
    edges = scratch.write(edges.where("u != v").select("u", "v").distinct())
    parents = scratch.write(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("p", F.col("id")))
    while True:
        ends = edges.join(parents.select(F.col("id").alias("u"), F.col("p").alias("pu")), "u").join(parents.select(F.col("id").alias("v"), F.col("p").alias("pv")), "v")
        hooks = ends.where("pu != pv").select(F.greatest("pu", "pv").alias("id"), F.least("pu", "pv").alias("to")).groupBy("id").agg(F.min("to").alias("to"))
        hooked = scratch.write(parents.join(hooks, "id", "left").select("id", F.least("p", F.coalesce("to", "p")).alias("p"), F.col("to").isNotNull().alias("moved")))
        up = hooked.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        short = scratch.write(hooked.join(up, "p").select("id", F.col("pp").alias("p"), (F.col("moved") | (F.col("pp") != F.col("p"))).alias("moved")))
        scratch.drop(parents, hooked)
        parents = short
        if short.where("moved").isEmpty():
            return short.select("id", F.col("p").alias("root"))


def labels_by_words(df: DataFrame, id_col: str, string_col: str, group_col: str) -> DataFrame:
    """(fp1, fp2, label, n, words, last): the labels with whose rows the same words occur, and the first and the last of their word
    lists, which are equal unless fingerprints collide. Rows without words or group count nowhere."""
    rows = fingerprints(df, id_col, string_col, group_col).where(F.col(f"_x_{group_col}").isNotNull())
    rows = rows.withColumn("words", F.array_join(F.array_sort(F.split("norm", " ")), " "))
    return rows.groupBy("fp1", "fp2", F.col(f"_x_{group_col}").alias("label")).agg(F.count("*").alias("n"), F.min("words").alias("words"), F.max("words").alias("last"))


def related(memberships: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(fp1, fp2, label, component) where two or more labels share words, and the seed of the label hashes.

    Words are compared in full: two word lists of one fingerprint would fail by name. A component is the smallest hash among
    its labels. Should two labels share a hash another seed is taken.
    """
    shared = memberships.groupBy("fp1", "fp2").agg(F.count("*").alias("labels"), F.min("words").alias("one"), F.max("last").alias("other")).where("labels > 1")
    clash = F.raise_error(F.concat(F.lit("fingerprints collide: "), F.col("one"), F.lit(" / "), F.col("other"))).cast("long")
    shared = shared.select("fp1", "fp2", F.when(F.col("one") == F.col("other"), F.col("labels")).otherwise(clash).alias("labels"))
    shared = scratch.write(join_unique(memberships.select("fp1", "fp2", "label"), shared, ["fp1", "fp2"], "labels", scratch=scratch).select("fp1", "fp2", "label"))
    for seed in range(SEEDS):
        ids = shared.select("label").distinct().withColumn("id", F.xxhash64("label", F.lit(seed)))
        if ids.groupBy("id").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("hashes of labels collide under every seed")
    named = shared.withColumn("id", F.xxhash64("label", F.lit(seed)))
    first = named.groupBy("fp1", "fp2").agg(F.min("id").alias("v"))
    roots = components(named.join(first, ["fp1", "fp2"]).select(F.col("id").alias("u"), "v"), scratch)
    return scratch.write(named.join(roots, "id").select("fp1", "fp2", "label", F.col("root").alias("component"))), seed


def related_pairs(df: DataFrame, id_col: str = "row_id", string_col: str = "string", group_col: str = "group") -> DataFrame:
    """(group0, group1), the first first by code point: different labels with the same words in a row of each.

    The pairs are the links inside each component. There are as many as the statement asks for: words with many labels give all
    of their pairs, in several tasks where there are very many labels.
    """
    scratch = Scratch(df.sparkSession)
    members, _ = related(labels_by_words(df, id_col, string_col, group_col), scratch)
    other = members.select("fp1", "fp2", "component", F.col("label").alias("group1"))
    pairs = join_each(members.withColumnRenamed("label", "group0"), other, ["component", "fp1", "fp2"]).where("group0 < group1")
    return pairs.select("group0", "group1").distinct()


def _pick(chunks: list[tuple[int, int]], at: int) -> list[tuple[int, int]]:
    """Chunks of sum `at`, which must be reachable: halves meet at a sum, so few bitsets are held at once."""
    if not at or len(chunks) == 1:
        return chunks if at else []
    first, second = chunks[: len(chunks) // 2], chunks[len(chunks) // 2 :]
    up, down, mask = 1, 1 << at, (1 << at + 1) - 1
    for size, take in first:
        up |= up << size * take & mask
    for size, take in second:
        down |= down >> size * take
    both = up & down
    m = (both & -both).bit_length() - 1
    return _pick(first, m) + _pick(second, at - m)


def closest(items: list[tuple[int, int]], target: float) -> dict[int, int]:
    """Of units of (size, number): how many of each size come closest to target in sum, from a bitset of all reachable sums.
    Of two equally close sums the smaller one."""
    chunks = []
    for size, number in items:
        k = 1
        while number:
            take = min(k, number)
            chunks.append((size, take))
            number -= take
            k *= 2
    bits = 1
    for size, take in chunks:
        bits |= bits << size * take
    target = max(target, 0)
    floor = int(target)
    below = (bits & (1 << floor + 1) - 1).bit_length() - 1
    more = bits >> floor + 1
    above = (more & -more).bit_length() + floor if more else None
    at = below if above is None or target - below <= above - target else above
    taken: dict[int, int] = {}
    for size, take in _pick(chunks, at):
        taken[size] = taken.get(size, 0) + take
    return taken


def _jointly(units: list[int], targets: list[float]) -> list[int] | None:
    """The split of each unit, of least sum of squared distances from the targets; None where more than STATES sums are met."""
    layers: list[dict[tuple[int, ...], tuple[tuple[int, ...], int] | None]] = [{(0,) * len(targets): None}]
    met = 1
    for u in units:
        layer: dict[tuple[int, ...], tuple[tuple[int, ...], int] | None] = {}
        for state in layers[-1]:
            for i in range(len(targets)):
                layer.setdefault(state[:i] + (state[i] + u,) + state[i + 1 :], (state, i))
        met += len(layer)
        if met > STATES:
            return None
        layers.append(layer)
    state = min(layers[-1], key=lambda x: (sum((a - t) ** 2 for a, t in zip(x, targets, strict=True)), x))
    out = []
    for layer in reversed(layers[1:]):
        state, i = layer[state]
        out.append(i)
    return out[::-1]


def _settle(given: dict[int, dict[str, int]], targets: dict[str, float]) -> None:
    """Bring the totals to the closest reachable ones, by the sum of squared distances; units of all sizes take part.

    Nothing is moved where the totals are the targets rounded. Otherwise each two splits share their units anew by a subset
    sum, until no two can be closer: exact for two splits. For more, all are dealt jointly while at most STATES sums are met;
    beyond that, each two splits are as close as they can be, which doesn't prove that all are.
    """
    names = list(targets)
    totals = lambda: {x: sum(s * by[x] for s, by in given.items()) for x in names}
    off = lambda t: sum((t[x] - targets[x]) ** 2 for x in names)
    low = {x: int(targets[x] + 1e-9) for x in names}
    left = sum(totals().values()) - sum(low.values())
    for x in sorted(names, key=lambda x: low[x] - targets[x])[:left]:
        low[x] += 1
    least, better = off(low) + 1e-6, True
    while better and off(totals()) > least:
        better = False
        for i, x in enumerate(names):
            for y in names[i + 1 :]:
                now = totals()
                both = {s: by[x] + by[y] for s, by in given.items() if by[x] + by[y]}
                taken = closest(sorted(both.items(), reverse=True), (targets[x] + now[x] + now[y] - targets[y]) / 2)
                mine = sum(s * k for s, k in taken.items())
                if off(now | {x: mine, y: now[x] + now[y] - mine}) < off(now) - 1e-6:
                    better = True
                    for s, n in both.items():
                        given[s][x], given[s][y] = taken.get(s, 0), n - taken.get(s, 0)
    if len(names) > 2 and off(totals()) > least and sum(sum(by.values()) for by in given.values()) < STATES:
        units = [s for s, by in sorted(given.items(), reverse=True) for _ in range(sum(by.values()))]
        dealt = _jointly(units, list(targets.values()))
        if dealt is not None:
            for by in given.values():
                by.update(dict.fromkeys(names, 0))
            for s, i in zip(units, dealt, strict=True):
                given[s][names[i]] += 1


def plan_splits(multiplicities: dict[int, int], shares: list[tuple[str, float]]) -> list[tuple[int, str, int, int]]:
    """(size, split, from, to): which units of each size, by their rank, go to which split.

    Units larger than 1/1000 of all rows go first, each to the split that lacks most. All smaller sizes are then shared out in
    proportion, so splits are alike in kind; what doesn't divide goes, largest first, to the split that lacks most; and
    reserved small units bring the totals close. Where they aren't the shares rounded then, units of all sizes are shared anew.
    """
    total = sum(s * n for s, n in multiplicities.items())
    whole = sum(share for _, share in shares) or 1.0
    names = [name for name, _ in shares]
    lack = {name: total * share / whole for name, share in shares}
    given: dict[int, dict[str, int]] = {s: dict.fromkeys(names, 0) for s in multiplicities}

    def give(size: int, name: str, n: int) -> None:
        given[size][name] += n
        lack[name] -= size * n

    most = lambda: max(names, key=lambda x: (lack[x], -names.index(x)))
    rest = dict(multiplicities)
    for s in sorted((s for s in rest if s * BIG > total), reverse=True):
        for _ in range(rest.pop(s)):
            give(s, most(), 1)
    spare = {s: min(n, RESERVE) if s <= SMALL else 0 for s, n in rest.items()}
    open_lack = {x: max(v, 0.0) for x, v in lack.items()}
    parts = sum(open_lack.values()) or 1.0
    for s, n in sorted(rest.items(), reverse=True):
        for x in names:
            k = int((n - spare[s]) * open_lack[x] / parts)
            give(s, x, k)
            rest[s] -= k
    for s in sorted((s for s in rest if s > SMALL), reverse=True):
        for _ in range(rest[s]):
            give(s, most(), 1)
        rest[s] = 0
    for x in sorted(names, key=lambda x: lack[x])[:-1]:
        for s, k in closest(sorted(((s, n) for s, n in rest.items() if n), reverse=True), round(lack[x])).items():
            give(s, x, k)
            rest[s] -= k
    last = most()
    for s, n in rest.items():
        give(s, last, n)
    if names:
        _settle(given, {name: total * share / whole for name, share in shares})
    out = []
    for s, by in given.items():
        at = 0
        for x in names:
            if by[x]:
                out.append((s, x, at, at + by[x]))
                at += by[x]
    return out


def grouped_splits(df: DataFrame, shares: DataFrame, id_col: str = "row_id", string_col: str = "string", group_col: str = "group") -> DataFrame:
    """(id, split, unit): every row with its split; unit is the same for all that had to stay together.

    Rows of one group, of groups that share words, and rows without group with the same words as these or as one another are a
    unit. A row without group and words is one by itself. Totals are the reachable ones closest to the shares (for three
    splits and more within the bound that _settle states), which are taken relative to their sum. No shares give no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    words = scratch.write(labels_by_words(df, id_col, string_col, group_col))
    members, seed = related(words, scratch)
    label_id = lambda c: F.xxhash64(c, F.lit(seed))
    roots = members.select(F.col("label").alias("g"), "component").distinct()
    every = df.select(F.col(id_col).alias("_id"), F.col(string_col).alias("_s"), F.col(group_col).alias("g"))
    # the unit of each label, with the number of its rows
    labelled = every.where("g is not null").groupBy("g").agg(F.count("*").alias("n")).join(roots, "g", "left").select("g", "n", F.coalesce("component", label_id("g")).alias("unit"))
    labelled = scratch.write(labelled)
    first = scratch.write(join_units(words, labelled).groupBy("fp1", "fp2").agg(F.min("unit").alias("known")))
    loose = fingerprints(every.where("g is null"), "_id", "_s")
    keys = loose.groupBy("fp1", "fp2").agg(F.count("*").alias("n")).join(first, ["fp1", "fp2"], "left")
    keys = keys.select("fp1", "fp2", "n", F.coalesce("known", F.xxhash64("fp1", "fp2")).alias("unit"))
    worded = scratch.write(join_unique(loose.select("_id", "fp1", "fp2"), keys, ["fp1", "fp2"], "n").select("_id", "unit"))
    wordless = every.where("g is null").select("_id").join(worded.select("_id"), "_id", "left_anti").select("_id", F.xxhash64("_id", F.lit(-1)).alias("unit"))
    by_label = join_unique(every.where("g is not null").select("_id", "g"), labelled, ["g"], "n").select("_id", "unit")
    rows = scratch.write(by_label.unionByName(worded).unionByName(wordless))
    scratch.drop()

    units = scratch.write(rows.groupBy("unit").agg(F.count("*").alias("size")))
    # at most sqrt(2 x rows) different sizes
    sizes = {r["size"]: r["n"] for r in units.groupBy("size").agg(F.count("*").alias("n")).collect()}
    wanted = [(r["split"], r["share"]) for r in shares.select("split", "share").where("share > 0").orderBy("split").collect()]
    plan = spark.createDataFrame(plan_splits(sizes, wanted) if wanted else [], "size long, split string, first long, after long")
    ranked = ranks(units, ["size"], F.col("unit"), most=max(sizes.values(), default=0))
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("size", "s")), F.expr("s = size AND rank >= first AND rank < after")).select("unit", "size", "split")
    return join_unique(rows, scratch.write(placed), ["unit"], "size").select(F.col("_id").alias(id_col), "split", "unit")


def split_report(rows: DataFrame, df: DataFrame, shares: DataFrame, id_col: str = "row_id", group_col: str = "group") -> DataFrame:
    """(split, share, rows, reached, parted): rows and their share in each split, and how many of all groups are in more than one."""
    sums = rows.groupBy("split").agg(F.count("*").alias("rows"))
    whole = rows.agg(F.count("*").alias("whole"))
    grouped = df.where(F.col(group_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(group_col).alias("g"))
    of = grouped.join(rows.select(F.col(id_col).alias("_id"), "split"), "_id").groupBy("g").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    parted = of.agg(F.count_if(F.col("a") != F.col("b")).alias("parted"))
    each = shares.select("split", "share").join(F.broadcast(sums), "split", "left").join(F.broadcast(whole)).join(F.broadcast(parted))  # a row for each split
    return each.select("split", "share", F.coalesce("rows", F.lit(0)).alias("rows"), F.round(F.coalesce("rows", F.lit(0)) / F.col("whole"), 4).alias("reached"), "parted")


def join_units(words: DataFrame, labelled: DataFrame) -> DataFrame:
    return words.select("fp1", "fp2", F.col("label").alias("g")).join(labelled.select("g", "unit"), "g")

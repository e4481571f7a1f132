"""Groups by similarity: threshold graphs, constrained agglomeration, nearest targets, separation."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import l2_normalize, score_to_cos
from ..functions.text import augmented
from ..plans.storage import Scratch
from .components import components
from .groups import relabel, split, split_all, unite_partition, unite_sets
from .vectors import joining_pairs, nearest_target, similar_pairs

#: Pairs of a component that one task decides.
COMPONENT = 200_000
#: Conflicts that a warning shows at most; always_never_conflicts has them all.
SHOWN = 20
LOG = "i string, j string, n_i long, n_j long, cos double"


def _sets(sets: DataFrame | None) -> DataFrame | None:
    """(set_id, string) of an always- or never-match table, each once."""
    return None if sets is None else sets.select(F.col("set_id").cast("long").alias("set_id"), F.col("string").alias("string")).where("string is not null").distinct()


def always_never_conflicts(matches: DataFrame, always: DataFrame, never: DataFrame) -> DataFrame:
    """(string, never_match_group, always_match_group): members of never-sets of which two share an always-group."""
    return label_conflicts(unite_sets(split_all(matches), _sets(always)).select("string", F.col("group").alias("label")), never)


def label_conflicts(labels: DataFrame, never: DataFrame) -> DataFrame:
    """The same where the always-groups are known: labels is (string, label)."""
    rows = _sets(never).join(labels, "string")
    bad = rows.groupBy("set_id").agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).where("k < n").select("set_id")
    return rows.join(bad, "set_id").select("string", F.col("set_id").alias("never_match_group"), F.col("label").alias("always_match_group"))


def _agglomerate(group_cos: float | None):
    """The greedy kernel on one component: pairs from the most similar on are united unless never-sets or the weakest link forbid it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows[rows["j"].isna()]
        of = {s: s for s in nodes["i"]}
        members = {s: [s] for s in nodes["i"]}
        total = dict(zip(nodes["i"], nodes["n"], strict=True))
        sets = {s: set(k) if k is not None else set() for s, k in zip(nodes["i"], nodes["never"], strict=True)}
        edges = rows[rows["j"].notna()]
        cos = {(i, j): c for i, j, c in zip(edges["i"], edges["j"], edges["cos"], strict=True)}
        dead: set[tuple[str, str]] = set()
        log = []
        for (i, j), c in sorted(cos.items(), key=lambda x: (-x[1], x[0])):
            a, b = of[i], of[j]
            if a == b or (i, j) in dead:
                continue
            ok = not sets[a] & sets[b]
            if ok and group_cos is not None and len(members[a]) + len(members[b]) > 2:
                ok = all(cos.get((min(x, y), max(x, y)), -2.0) >= group_cos for x in members[a] for y in members[b])
            if not ok:
                # all pairs between the two groups as they are now are given up
                dead |= {(min(x, y), max(x, y)) for x in members[a] for y in members[b]}
                continue
            log.append((i, j, total[a], total[b], c))
            if len(members[a]) < len(members[b]):
                a, b = b, a
            for x in members[b]:
                of[x] = a
            members[a] += members.pop(b)
            total[a] += total.pop(b)
            sets[a] |= sets.pop(b)
        return pd.DataFrame(log, columns=["i", "j", "n_i", "n_j", "cos"])

    return run


def agglomerate_rounds(nodes: DataFrame, edges: DataFrame, group_cos: float | None, scratch: Scratch) -> DataFrame:
    """What the kernel does, for components of any size: (i, j, n_i, n_j, cos) from nodes (i, n, never) and edges (i, j, cos), i < j.

    The pair that is the most similar one of both of its groups comes before any other that could change them, so all such pairs
    are decided in one round, each the way one after the other would. Of two groups only the most similar pair, and how many
    pairs reach group_cos, are kept, and both add up when groups are united; pairs that are given up are dropped.
    """
    groups = scratch.write(nodes.select(F.col("i").alias("g"), "n", F.lit(1).cast("long").alias("k"), F.coalesce("never", F.array().cast("array<long>")).alias("never")))
    best = F.struct((-F.col("cos")).alias("far"), "i", "j", F.lit(True).alias("straight"))  # straight: i is on a's side
    near = (F.col("cos") >= group_cos).cast("long") if group_cos is not None else F.lit(0).cast("long")
    state = scratch.write(edges.select(F.col("i").alias("a"), F.col("j").alias("b"), best.alias("best"), near.alias("m")))
    logs: list[DataFrame] = []
    while not state.isEmpty():
        ends = state.select(F.explode(F.array("a", "b")).alias("x"), "best").groupBy("x").agg(F.min("best").alias("best"))
        of = lambda c: ends.select(F.col("x").alias(c), F.col("best").alias(f"best_{c}"))  # noqa: B023, E731
        group = lambda c: groups.select(F.col("g").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "k", "never")))  # noqa: B023, E731
        top = state.join(of("a"), "a").join(of("b"), "b").where((F.col("best") == F.col("best_a")) & (F.col("best") == F.col("best_b")))
        ok = ~F.arrays_overlap("never_a", "never_b")
        if group_cos is not None:
            ok &= (F.col("k_a") + F.col("k_b") <= 2) | (F.col("m") == F.col("k_a") * F.col("k_b"))
        side = lambda yes, no: F.when(F.col("best.straight"), F.col(yes)).otherwise(F.col(no))
        decided = top.join(group("a"), "a").join(group("b"), "b").select("a", "b", ok.alias("ok"), "best.i", "best.j", side("n_a", "n_b").alias("n_i"), side("n_b", "n_a").alias("n_j"), (-F.col("best.far")).alias("cos"))
        decided = scratch.write(decided)
        united = decided.where("ok")
        logs.append(united.select("i", "j", "n_i", "n_j", "cos"))
        to = united.select(F.col("b").alias("old"), F.col("a").alias("new"))
        moved = groups.join(to, F.col("g") == F.col("old"), "left").select(F.coalesce("new", "g").alias("g"), "n", "k", "never")
        after = scratch.write(moved.groupBy("g").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.array_distinct(F.flatten(F.collect_list("never"))).alias("never")))  # two at most
        rest = state.join(decided.select("a", "b"), ["a", "b"], "left_anti")
        for c in ("a", "b"):
            rest = rest.join(to.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}")), c, "left")
        x, y = F.coalesce("new_a", "a"), F.coalesce("new_b", "b")
        turned = F.struct("best.far", "best.i", "best.j", (F.col("best.straight") == (x < y)).alias("straight"))
        rest = rest.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), turned.alias("best"), "m").groupBy("a", "b").agg(F.min("best").alias("best"), F.sum("m").alias("m"))
        rest = scratch.write(rest)
        scratch.drop(state, groups)
        state, groups = rest, after
    empty = nodes.sparkSession.createDataFrame([], LOG)
    return reduce(DataFrame.unionByName, logs, empty)


def unite_similar(
    vectors: DataFrame, threshold: float = 0.5, alpha: float = 50.0, group_threshold: float | None = None, always: DataFrame | None = None, never: DataFrame | None = None, conflicts: str = "warn", unit: bool = False
) -> DataFrame:
    """A partition of the vectors' strings by similarity score.

    Without group_threshold and never, groups are the components of all pairs of at least the threshold and of the always-sets.
    With them pairs are united from the most similar on (ties by strings), unless a never-set has members on both sides, or the
    merged group would have three or more strings and any cosine across is below group_threshold; always-sets are united last and
    win. vectors is (string, count, v); unit: they aren't at length one yet, here they are taken so.
    """
    strings = vectors.select("string", "count", F.col("string").alias("group"))
    if not group_threshold and never is None:
        pairs = joining_pairs(vectors, score_to_cos(threshold, alpha), unit)
        if always is not None:
            first = _sets(always).join(strings.select("string"), "string", "left_semi")
            first = first.join(first.groupBy("set_id").agg(F.min("string").alias("first")), "set_id")
            pairs = pairs.unionByName(first.select(F.col("first").alias("string0"), F.col("string").alias("string1")))
        roots = components(pairs, "string0", "string1").select(F.col("member").alias("string"), "root")
        return relabel(strings.join(roots, "string", "left").select("string", "count", F.coalesce("root", "string").alias("group")))
    log = united_pairs(vectors.withColumn("v", l2_normalize(F.col("v"))) if unit else vectors, threshold, alpha, group_threshold, always, never, conflicts)
    roots = components(log, "i", "j").select(F.col("member").alias("string"), "root")
    found = relabel(strings.join(roots, "string", "left").select("string", "count", F.coalesce("root", "string").alias("group")))
    return found if always is None else unite_sets(found, _sets(always))


def united_pairs(
    vectors: DataFrame, threshold: float = 0.5, alpha: float = 50.0, group_threshold: float | None = None, always: DataFrame | None = None, never: DataFrame | None = None, conflicts: str = "warn"
) -> DataFrame:
    """(i, j, n_i, n_j, cos[, always_match]): the pairs that the constrained way unites, with both groups' counts before.

    Greedy choices never look beyond a component of the threshold graph, so a component is one task's work while it has at most
    COMPONENT pairs; a larger one is decided in rounds over tables. Without constraints the pairs are the maximum spanning forest.
    """
    if group_threshold and group_threshold < threshold:
        raise ValueError("group_threshold is below threshold")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    strings = vectors.select("string", "count", F.col("string").alias("group"))
    pairs = scratch.write(similar_pairs(vectors, score_to_cos(threshold, alpha)))
    labels = unite_sets(strings, _sets(always)).select("string", F.col("group").alias("label")) if always is not None else strings.select("string", F.col("string").alias("label"))
    labels = scratch.write(labels)
    blocked = None
    if never is not None:
        if always is not None and conflicts in ("warn", "raise"):
            bad = always_never_conflicts(strings, always, never).limit(SHOWN).collect()
            if bad and conflicts == "raise":
                raise ValueError("never-match sets conflict with always-match sets; see always_never_conflicts")
            if bad:
                shown = "; ".join(f"{r['string']!r} in never-set {r['never_match_group']}, always with {r['always_match_group']!r}" for r in bad)
                logging.getLogger(__name__).warning("never-match sets conflict with always-match sets, the first are: %s", shown)
        # a never-set holds for all strings with an always-label of its members
        blocked = _sets(never).join(labels, "string").select("set_id", "label").distinct().join(labels, "label").groupBy("string").agg(F.array_sort(F.collect_set("set_id")).alias("never"))
    roots = scratch.write(components(pairs, "string0", "string1").select(F.col("member").alias("string"), "root"))
    nodes = strings.join(roots, "string").select("root", F.col("string").alias("i"), F.col("count").alias("n"))
    nodes = nodes.join(blocked.withColumnRenamed("string", "i"), "i", "left") if blocked is not None else nodes.withColumn("never", F.lit(None).cast("array<long>"))
    nodes = nodes.select("root", "i", F.lit(None).cast("string").alias("j"), "n", "never", F.lit(None).cast("double").alias("cos"))
    edges = pairs.join(roots.withColumnRenamed("string", "string0"), "string0").select("root", F.col("string0").alias("i"), F.col("string1").alias("j"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<long>").alias("never"), "cos")
    kernel = _agglomerate(score_to_cos(group_threshold, alpha) if group_threshold else None)
    # a component of very many pairs isn't one task's work: its pairs are decided in rounds
    large = scratch.write(edges.groupBy("root").agg(F.count("*").alias("k")).where(F.col("k") > COMPONENT).select("root"))
    if large.isEmpty():
        log = nodes.unionByName(edges).groupBy("root").applyInPandas(kernel, LOG)
    else:
        far = score_to_cos(group_threshold, alpha) if group_threshold else None
        rounds = agglomerate_rounds(nodes.join(large, "root").select("i", "n", "never"), edges.join(large, "root").select("i", "j", "cos"), far, scratch)
        log = nodes.unionByName(edges).join(large, "root", "left_anti").groupBy("root").applyInPandas(kernel, LOG).unionByName(rounds)
    if always is None:
        return log
    a, b = labels.select(F.col("string").alias("i"), F.col("label").alias("_a")), labels.select(F.col("string").alias("j"), F.col("label").alias("_b"))
    return log.join(a, "i").join(b, "j").select("i", "j", "n_i", "n_j", "cos", (F.col("_a") == F.col("_b")).alias("always_match"))


def unite_nearest(matches: DataFrame, vectors: DataFrame, targets: DataFrame, threshold: float = 0.0, alpha: float = 50.0, always: DataFrame | None = None) -> DataFrame:
    """Each string that isn't a target joins the group of its nearest target where the score is above the threshold (0: always);
    only the string moves, not its old group. Targets stay where they are; an unknown target fails when it is run."""
    wanted = targets.select(F.col(targets.columns[0]).alias("string")).distinct()
    error = F.raise_error(F.concat(F.lit("unknown target: "), F.col("string"))).cast("array<double>")
    known = wanted.join(vectors.select("string", "v"), "string", "left").withColumn("v", F.coalesce(F.col("v").cast("array<double>"), error))
    others = vectors.select("string", "v").join(wanted, "string", "left_anti")
    if always is not None:
        mine = _sets(always)
        tied = mine.join(mine.join(wanted, "string").select("set_id").distinct(), "set_id").select("string").distinct()
        others = others.join(tied, "string", "left_anti")
    near = nearest_target(others, known, score_to_cos(threshold, alpha)).select("string", "target")
    start = matches if always is None else unite_sets(matches, _sets(always))
    groups = start.select(F.col("string").alias("target"), F.col("group").alias("_g"))
    moved = start.join(near, "string", "left").join(groups, "target", "left")
    return relabel(moved.select("string", "count", F.coalesce("_g", "group").alias("group")))


def separate(matches: DataFrame, vectors: DataFrame, strings: DataFrame, threshold: float = 0.0, alpha: float = 50.0) -> DataFrame:
    """Groups that hold two or more of the strings are split and clustered anew with the strings kept apart."""
    apart = strings.select(F.col(strings.columns[0]).alias("string")).distinct()
    held = matches.join(apart, "string", "left_semi").groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    hit = matches.join(held, "group", "left_semi").select("string", "count", "group")
    scratch = Scratch(matches.sparkSession)
    hit = scratch.write(hit)
    # each affected group by itself: its place in the set ids keeps sets of different groups apart
    mine = vectors.select("string", "v").join(hit.select("string", "count"), "string")
    never = hit.join(apart, "string", "left_semi").select(F.xxhash64("group").alias("set_id"), "string")
    groups = hit.select("string", "group")
    found = unite_similar_within(mine, groups, threshold, alpha, never)
    loose = split(matches, hit.select("string"))
    return unite_partition(loose, found)


def unite_similar_within(vectors: DataFrame, groups: DataFrame, threshold: float, alpha: float, never: DataFrame) -> DataFrame:
    """unite_similar with never-sets where only pairs of one group of `groups` may be united."""
    scratch = Scratch(vectors.sparkSession)
    pairs = similar_pairs(vectors, score_to_cos(threshold, alpha))
    g = lambda k: groups.select(F.col("string").alias(f"string{k}"), F.col("group").alias(f"g{k}"))
    pairs = scratch.write(pairs.join(g(0), "string0").join(g(1), "string1").where("g0 = g1").select(F.col("g0").alias("root"), F.col("string0").alias("i"), F.col("string1").alias("j"), "cos"))
    blocked = never.groupBy("string").agg(F.array_sort(F.collect_set("set_id")).alias("never"))
    nodes = groups.join(vectors.select("string", "count"), "string").join(blocked, "string", "left")
    nodes = nodes.select(F.col("group").alias("root"), F.col("string").alias("i"), F.lit(None).cast("string").alias("j"), F.col("count").alias("n"), "never", F.lit(None).cast("double").alias("cos"))
    edges = pairs.select("root", "i", "j", F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<long>").alias("never"), "cos")
    log = nodes.unionByName(edges).groupBy("root").applyInPandas(_agglomerate(None), LOG)
    roots = components(log, "i", "j").select(F.col("member").alias("string"), "root")
    strings = vectors.select("string", "count")
    return relabel(strings.join(roots, "string", "left").select("string", "count", F.coalesce("root", "string").alias("group")))


Encoder = Callable[[list[str]], "np.ndarray"]


def hashed_ngrams(strings: list[str], n: int = 3, size: int = 64) -> np.ndarray:
    """An encoder without a model: signed counts of hashed character n-grams, at length one."""
    import xxhash

    out = np.zeros((len(strings), size))
    for row, s in zip(out, strings, strict=True):
        for i in range(max(len(s) - n + 1, 1)):
            h = xxhash.xxh64_intdigest(s[i : i + n])
            row[h % size] += 1 if h >> 63 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode(strings: DataFrame, encoder: Encoder, column: str = "string", prompt: str = "", upper: bool = False, batch: int = 512) -> DataFrame:
    """(string, v): each different string once with its vector at length one, zero vectors left out.

    encoder makes a matrix of a list of strings and runs in Arrow batches on the executors; prompt and upper augment what it
    reads. Its object goes to the workers, so a large model should load itself there once.
    """

    def run(batches):
        for b in batches:
            texts, given = b.column(1).to_pylist(), b.column(0)
            for i in range(0, len(texts), batch):
                v = np.asarray(encoder(texts[i : i + batch]), np.float64)
                yield pa.RecordBatch.from_arrays([given.slice(i, batch), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["string", "v"])

    each = strings.where(F.col(column).isNotNull()).select(F.col(column).alias("string")).distinct()
    text = augmented("string", prompt) if upper else F.concat(F.lit(prompt), F.col("string"))
    made = each.select("string", text.alias("t")).mapInArrow(run, "string string, v array<double>")
    return made.select("string", l2_normalize(F.col("v")).alias("v")).where("v is not null")


class SimilarityModel:
    """A vector table or an encoder with the score's parameters, for unite(matches, model)."""

    def __init__(self, vectors: DataFrame | None = None, alpha: float = 50.0, exponent: float = 0.5, encoder: Encoder | None = None, prompt: str = "", upper: bool = False):
        if vectors is None and encoder is None:
            raise ValueError("a model needs vectors or an encoder")
        self.vectors, self.alpha, self.exponent, self.encoder, self.prompt, self.upper = vectors, alpha, exponent, encoder, prompt, upper

    def embed(self, matches: DataFrame) -> DataFrame:
        """(string, count, w, v) of the strings in matches."""
        from .vectors import with_counts

        vectors = self.vectors if self.vectors is not None else encode(matches, self.encoder, "string", self.prompt, self.upper)
        return with_counts(vectors, matches, self.exponent)

    def unite_similar(self, matches: DataFrame, **options) -> DataFrame:
        return unite_similar(self.embed(matches).select("string", "count", "v"), alpha=self.alpha, **options)

    def save(self, path: str, matches: DataFrame | None = None) -> None:
        """The vectors (an encoder's for the strings of matches) and parameters. Code isn't saved: load() takes an encoder again."""
        from ..sources.tables import save_vectors

        vectors = self.vectors if self.vectors is not None else None if matches is None else self.embed(matches).select("string", "v")
        if vectors is None:
            raise ValueError("give the strings whose vectors are to be saved")
        save_vectors(vectors, path, alpha=self.alpha, exponent=self.exponent, prompt=self.prompt, upper=self.upper)

    @staticmethod
    def load(spark: SparkSession, path: str, encoder: Encoder | None = None) -> SimilarityModel:
        """What save() wrote; with an encoder that is used instead of the saved vectors."""
        from ..sources.tables import load_vectors

        vectors, parameters = load_vectors(spark, path)
        return SimilarityModel(None if encoder else vectors, encoder=encoder, **parameters)

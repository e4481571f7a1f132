"""Scoring a predicted partition against a gold one; splits and folds that keep groups whole; summaries of runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scores import score_to_cos
from ..plans.skew import join_unique
from ..plans.storage import Scratch
from .components import components
from .groups import relabel
from .vectors import similar_pairs

WIDE = "decimal(38,0)"


def _joined(predicted: DataFrame, gold: DataFrame, use_counts: bool) -> DataFrame:
    n = F.col("count").cast(WIDE) if use_counts else F.lit(1).cast(WIDE)
    p = predicted.select("string", n.alias("c"), F.col("group").alias("group_pred"))
    return p.join(gold.select("string", F.col("group").alias("group_gold")), "string")


def confusion_rows(predicted: DataFrame, gold: DataFrame, use_counts: bool = True) -> DataFrame:
    """(string, count, group_pred, group_gold, TP, FP, FN, TN) of each string in both: its pairs with all others, counts being copies.
    The four are DECIMAL(38,0), as squares of counts pass the range of a BIGINT.

    Sums come from aggregates joined back, a hot group's by broadcast, so no window holds it.
    """
    scratch = Scratch(predicted.sparkSession)
    rows = scratch.write(_joined(predicted, gold, use_counts))
    cells = scratch.write(rows.groupBy("group_pred", "group_gold").agg(F.sum("c").alias("npg"), F.count("*").alias("k")))
    left = cells.groupBy("group_pred").agg(F.sum("npg").alias("np"), F.sum("k").alias("kp"))
    right = cells.groupBy("group_gold").agg(F.sum("npg").alias("ng"), F.sum("k").alias("kg"))
    total = rows.agg(F.sum("c").alias("n"))
    each = rows
    for sums, keys, k in ((cells, ["group_pred", "group_gold"], "k"), (left, ["group_pred"], "kp"), (right, ["group_gold"], "kg")):
        each = scratch.write(join_unique(each, sums, keys, k))
    each = each.crossJoin(F.broadcast(total))  # one row
    own = lambda s: (F.col(s) - F.col("c")) * F.col("c")
    out = each.select("string", F.col("c").alias("count"), "group_pred", "group_gold", own("npg").alias("TP"), (own("np") - own("npg")).alias("FP"), (own("ng") - own("npg")).alias("FN"), (own("n") - own("np") - own("ng") + own("npg")).alias("TN"))
    return out.select("string", F.col("count").cast("long"), "group_pred", "group_gold", *(F.col(c).cast(WIDE).alias(c) for c in ("TP", "FP", "FN", "TN")))


def confusion_matrix(predicted: DataFrame, gold: DataFrame, use_counts: bool = True) -> DataFrame:
    """(TP, FP, FN, TN) over all unordered pairs, from the sums of cells, rows and columns of the contingency table."""
    rows = _joined(predicted, gold, use_counts)
    cells = Scratch(predicted.sparkSession).write(rows.groupBy("group_pred", "group_gold").agg(F.sum("c").cast(WIDE).alias("s"), F.sum(F.col("c") * F.col("c")).cast(WIDE).alias("q")))
    square = lambda c: F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0)).cast(WIDE)
    a = cells.agg(square("s").alias("pg"), F.coalesce(F.sum("q"), F.lit(0)).cast(WIDE).alias("q"), F.coalesce(F.sum("s"), F.lit(0)).cast(WIDE).alias("n"))
    b = cells.groupBy("group_pred").agg(F.sum("s").cast(WIDE).alias("s")).agg(square("s").alias("p"))
    c = cells.groupBy("group_gold").agg(F.sum("s").cast(WIDE).alias("s")).agg(square("s").alias("g"))
    one = a.crossJoin(b).crossJoin(c)  # three one-row tables
    half = lambda e: F.expr(f"CAST(({e}) / 2 AS DECIMAL(38,0))")
    return one.select(half("pg - q").alias("TP"), half("p - pg").alias("FP"), half("g - pg").alias("FN"), half("n * n - p - g + pg").alias("TN"))


def score_predicted(predicted: DataFrame, gold: DataFrame, use_counts: bool = True) -> DataFrame:
    """TP, FP, TN, FN, coverage, accuracy, precision, recall, F1 in one row. Without true positives the last four are 0;
    coverage, the scored share of the predicted pairs, is null where no pair was predicted."""
    m = confusion_matrix(predicted, gold, use_counts)
    n = F.col("count").cast(WIDE) if use_counts else F.lit(1).cast(WIDE)
    all_pairs = predicted.agg(F.sum(n).alias("s"), F.sum(n * n).alias("q")).select(((F.col("s") * F.col("s") - F.col("q")) / 2).cast("double").alias("pairs"))
    one = m.crossJoin(all_pairs)
    d = lambda c: F.col(c).cast("double")
    scored = d("TP") + d("FP") + d("FN") + d("TN")
    some = lambda e: F.when(F.col("TP") > 0, e).otherwise(F.lit(0.0))
    return one.select(
        "TP", "FP", "TN", "FN", F.try_divide(scored, F.col("pairs")).alias("coverage"), some(F.try_divide(d("TP") + d("TN"), scored)).alias("accuracy"),
        some(F.try_divide(d("TP"), d("TP") + d("FP"))).alias("precision"), some(F.try_divide(d("TP"), d("TP") + d("FN"))).alias("recall"),
        some(F.try_divide(2 * d("TP"), 2 * d("TP") + d("FP") + d("FN"))).alias("F1"),
    )


def _ranked(matches: DataFrame, order: Column) -> DataFrame:
    """(group, r, n): groups in an order with their place from 0 and their number, by a range sort and places of its partitions."""
    groups = matches.select("group").distinct().withColumn("_o", order)
    ranged = groups.repartitionByRange(F.col("_o"), F.col("group")).sortWithinPartitions("_o", "group").withColumn("_p", F.spark_partition_id())
    ranged = Scratch(matches.sparkSession).write(ranged)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("k"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("k").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")  # one row a partition
    inside = ranged.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy("_o", "group")) - 1)
    total = sizes.agg(F.sum("k").alias("n"))
    return inside.join(F.broadcast(before), "_p").crossJoin(F.broadcast(total)).select("group", (F.col("_before") + F.col("_i")).alias("r"), "n")


def split_on_groups(matches: DataFrame, frac: float = 0.5, seed: int = 0) -> DataFrame:
    """(string, count, group, part): whole groups in part 1 (a share frac of the groups, rounded down) or 2, in the order of
    md5(seed:group)."""
    places = _ranked(matches, F.md5(F.concat(F.lit(f"{seed}:"), F.col("group")).cast("binary")))
    part = F.when(F.col("r") < F.floor(F.col("n") * F.lit(frac)), F.lit(1)).otherwise(F.lit(2))
    parts = places.select("group", part.alias("part"))
    sized = matches.groupBy("group").agg(F.count("*").alias("_n")).join(parts, "group")
    return join_unique(matches, sized, ["group"], "_n").select("string", "count", "group", "part")


def kfold_on_groups(matches: DataFrame, k: int = 4, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """(string, count, group, fold): the group's place in label order, or in the order of md5(seed:group), modulo k."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("group")).cast("binary")) if shuffle else F.lit("")
    folds = _ranked(matches, order).select("group", F.pmod(F.col("r"), F.lit(k)).cast("int").alias("fold"))
    sized = matches.groupBy("group").agg(F.count("*").alias("_n")).join(folds, "group")
    return join_unique(matches, sized, ["group"], "_n").select("string", "count", "group", "fold")


def threshold_sweep(vectors: DataFrame, gold: DataFrame, thresholds: Iterable[float], alpha: float, use_counts: bool = True) -> DataFrame:
    """score_predicted at each threshold. Pairs are made once, at the lowest threshold; from the highest on, each threshold only
    joins the groups of the one before by the pairs that came in between."""
    steps = sorted({float(t) for t in thresholds}, reverse=True)
    scratch = Scratch(vectors.sparkSession)
    pairs = scratch.write(similar_pairs(vectors, score_to_cos(steps[-1], alpha)))
    state = scratch.write(vectors.select("string", "count", F.col("string").alias("group")))
    out, upper = None, None
    for t in steps:
        low = F.col("cos") >= score_to_cos(t, alpha)
        fresh = pairs.where(low if upper is None else low & (F.col("cos") < upper))
        a, b = state.select(F.col("string").alias("string0"), F.col("group").alias("a")), state.select(F.col("string").alias("string1"), F.col("group").alias("b"))
        roots = components(fresh.join(a, "string0").join(b, "string1").where("a != b").select("a", "b"), "a", "b").select(F.col("member").alias("group"), "root")
        state = scratch.write(relabel(state.join(roots, "group", "left").select("string", "count", F.coalesce("root", "group").alias("group"))))
        row = score_predicted(state, gold, use_counts).withColumn("threshold", F.lit(t))
        out, upper = row if out is None else out.unionByName(row), score_to_cos(t, alpha)
    return out


def best_threshold(sweep: DataFrame) -> DataFrame:
    """(threshold, F1) of greatest F1, ties to the lower threshold."""
    top = F.min_by(F.struct("threshold", "F1"), F.struct(-F.round("F1", 12), F.col("threshold"))).alias("b")
    return sweep.agg(top).select("b.threshold", "b.F1")


def _quantile(value: str, share: float, accuracy: int | None) -> Column:
    """Exact and interpolated, or a value whose rank is off by 1/accuracy of the group at most, in memory that doesn't grow with it."""
    return F.percentile(value, share) if accuracy is None else F.percentile_approx(value, share, accuracy)


def threshold_summary(runs: DataFrame, by: str, value: str, share: float = 0.8, accuracy: int | None = None) -> DataFrame:
    """Mean, quantile, greatest value and sample deviation of value by `by`. An exact quantile holds a group's different values in
    one task: give an accuracy where these are very many."""
    q = _quantile(value, share, accuracy).alias("quantile")
    return runs.groupBy(by).agg(F.avg(value).alias("mean"), q, F.max(value).alias("greatest"), F.stddev_samp(value).alias("deviation"), F.count(value).alias("runs"))


def rolling_mean(steps: DataFrame, by: str, order: list[str], value: str, rows: int = 100) -> DataFrame:
    """steps with rolling_mean over the last `rows` steps of each run, null until there are that many."""
    frame = W.partitionBy(by).orderBy(*order).rowsBetween(1 - rows, 0)
    return steps.withColumn("rolling_mean", F.when(F.count("*").over(frame) == rows, F.avg(value).over(frame)))


def topk_mean(runs: DataFrame, by: str, value: str, tie: str, k: int = 5) -> DataFrame:
    """Mean of the k greatest values of each `by`."""
    top = W.partitionBy(by).orderBy(F.desc(value), tie)
    return runs.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k).groupBy(by).agg(F.avg(value).alias("top_mean"))


def above_quantile(runs: DataFrame, by: str, value: str, share: float = 0.75, accuracy: int | None = None) -> DataFrame:
    """Rows whose value reaches its group's quantile; the quantile is aggregated, then joined. accuracy as in threshold_summary."""
    q = runs.groupBy(by).agg(_quantile(value, share, accuracy).alias("quantile"), F.count("*").alias("_n"))
    return join_unique(runs, q, [by], "_n").where(F.col(value) >= F.col("quantile")).drop("_n")

"""Problem 1: the best record of each duplicate group, with a latent truth model of the sources' quality.

Sources claim values for entities. A source has a sensitivity (how many true values it brings) and a specificity (how few
false ones); which values are true is not known, and an entity may have several. Expectation-maximisation finds both: the
posterior of each value from its claims and non-claims, then the sources' two rates from the posteriors.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_unique
from ..plans.storage import Scratch

#: Priors, as pseudo-counts: sources bring a true value more often than not and rarely a false one.
PRIOR_TRUE, PRIOR_SENS, PRIOR_SPEC = (10.0, 10.0), (5.0, 5.0), (90.0, 10.0)
MAX_ROUNDS, TOLERANCE = 20, 1e-4


def claims(df: DataFrame, group: str = "group", string: str = "string", count: str = "count", feed: str = "feed", seen: str = "seen_at", row_id: str = "row_id") -> DataFrame:
    """Rows delivered again (same string, count, group, feed, seen) once, with their smallest id; no null group or string."""
    rows = df.select(*(F.col(c).alias(a) for c, a in ((group, "g"), (string, "s"), (count, "n"), (feed, "f"), (seen, "t"), (row_id, "id"))))
    return rows.where(F.col("g").isNotNull() & F.col("s").isNotNull()).groupBy("g", "s", "n", "f", "t").agg(F.min("id").alias("id"))


def facts(once: DataFrame) -> DataFrame:
    """One row for each value of each entity: (g, s, weight, id, feeds). id is the value's best row: one with a count before
    one without, then the latest, then the smallest id. Two aggregations with map-side parts: a hot value needs no big task."""
    best = F.max_by("id", F.struct(F.col("n").isNotNull(), F.col("t"), -F.col("id")))
    return once.groupBy("g", "s").agg(F.sum(F.coalesce("n", F.lit(1))).alias("weight"), best.alias("id"), F.array_sort(F.collect_set("f")).alias("feeds"))


class Quality:
    """Fitted sensitivities and specificities of the sources and the share of true values."""

    def __init__(self, sens: dict[str, float], spec: dict[str, float], true: float):
        self.sens, self.spec, self.true = sens, spec, true

    def posterior(self, by: Column, covering: Column) -> Column:
        """P(true) of a value claimed by the feeds in `by`, of an entity that the feeds in `covering` know."""

        def table(of: dict[str, float]) -> Column:
            return F.create_map(*(x for f, v in sorted(of.items()) for x in (F.lit(f), F.lit(float(v))))) if of else F.create_map(F.lit(""), F.lit(0.0))

        yes = table({f: math.log(self.sens[f]) - math.log(1 - self.spec[f]) for f in self.sens})
        no = table({f: math.log(1 - self.sens[f]) - math.log(self.spec[f]) for f in self.sens})
        odds = F.aggregate(by, F.lit(math.log(self.true) - math.log(1 - self.true)), lambda a, f: a + F.coalesce(F.element_at(yes, f), F.lit(0.0)))
        odds = F.aggregate(F.array_except(covering, by), odds, lambda a, f: a + F.coalesce(F.element_at(no, f), F.lit(0.0)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(odds, F.lit(500.0)), F.lit(-500.0))))


def _estep(batches, sens: dict[str, float], spec: dict[str, float], true: float):
    """Sums by source over claim patterns: true values claimed and all true ones, false values not claimed and all false ones."""
    yes = {f: math.log(sens[f]) - math.log(1 - spec[f]) for f in sens}
    no = {f: math.log(1 - sens[f]) - math.log(spec[f]) for f in sens}
    sums = {f: [0.0] * 4 for f in sens} | {"": [0.0] * 4}
    for batch in batches:
        for by, covering, n in zip(batch["by"], batch["covering"], batch["facts"], strict=True):
            said = set(by)
            odds = math.log(true) - math.log(1 - true) + sum(yes[f] if f in said else no[f] for f in covering)
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            for f in covering:
                of = sums[f]
                of[0] += n * p * (f in said)
                of[1] += n * p
                of[2] += n * (1 - p) * (f not in said)
                of[3] += n * (1 - p)
            sums[""][0] += n * p
            sums[""][1] += n
    yield pd.DataFrame([(f, *v) for f, v in sums.items()], columns=["f", "tp", "t", "tn", "n"])


def fit_quality(patterns: DataFrame) -> Quality:
    """EM over (by, covering, facts): claim patterns with the number of values that show them.

    The pattern table is what all values come down to. A round passes over it where it lies, and sends four sums a source to
    the driver, never values or entities. An empty table leaves the starting rates.
    """
    sources = sorted(r[0] for r in patterns.select(F.explode("covering").alias("f")).where("f is not null").distinct().collect())
    q = Quality({f: 0.6 for f in sources}, {f: 0.9 for f in sources}, 0.5)
    patterns = patterns.select(F.array_compact("by").alias("by"), F.array_compact("covering").alias("covering"), "facts")
    for _ in range(MAX_ROUNDS if sources else 0):
        step = lambda it, q=q: _estep(it, q.sens, q.spec, q.true)
        sums = patterns.mapInPandas(step, "f string, tp double, t double, tn double, n double").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("tp", "t", "tn", "n")))
        rows = {r["f"]: r for r in sums.collect()}
        sens = {f: (rows[f]["tp"] + PRIOR_SENS[0]) / (rows[f]["t"] + sum(PRIOR_SENS)) for f in sources}
        spec = {f: (rows[f]["tn"] + PRIOR_SPEC[0]) / (rows[f]["n"] + sum(PRIOR_SPEC)) for f in sources}
        new = Quality(sens, spec, (rows[""]["tp"] + PRIOR_TRUE[0]) / (rows[""]["t"] + sum(PRIOR_TRUE)))
        moved = max(abs(new.sens[f] - q.sens[f]) + abs(new.spec[f] - q.spec[f]) for f in sources)
        q = new
        if moved < TOLERANCE:
            break
    return q


def _entities(values: DataFrame, kept: list[str], *more: Column) -> DataFrame:
    """(g, best, strings, more...) of each entity of two or more values; best holds the kept columns of the heaviest value."""
    best = F.min_by(F.struct(*kept), F.struct(-F.col("weight"), F.col("s"))).alias("best")
    return values.groupBy("g").agg(best, F.count("*").alias("strings"), *more).where("strings > 1")


def _fit(df: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, DataFrame, Quality]:
    """The values of all entities, the entities of two or more values, and the sources' fitted quality."""
    scratch = Scratch(df.sparkSession)
    values = scratch.write(facts(claims(df, **columns)))
    cover = F.array_sort(F.array_distinct(F.flatten(F.collect_set("feeds")))).alias("covering")  # sets of feeds, so bounded by the sources
    entities = scratch.write(_entities(values, ["s", "id", "weight", "feeds"], cover))
    # values of the same claims behave alike: the number of values by (claims, covering feeds) is all that EM needs
    by_claims = values.groupBy("g", "feeds").agg(F.count("*").alias("facts"))
    joined = by_claims.join(entities.select("g", "covering"), "g")
    patterns = scratch.write(joined.groupBy(F.col("feeds").alias("by"), "covering").agg(F.sum("facts").alias("facts")))
    return values, entities, fit_quality(patterns)


def survivors(df: DataFrame, **columns: str) -> DataFrame:
    """For each group that holds two or more different strings, its survivor by counts and dates: (group, row_id, string, count, strings).

    string is the value with the greatest sum of count (a null counts 1, a row delivered again counts once, ties: the first
    string); row_id is its best row (see facts). Groups of one value, null groups and null strings give no row; an empty string
    is a value. The model of sources has no part in this, so it isn't fitted.
    """
    entities = _entities(facts(claims(df, **columns)), ["s", "id", "weight"])
    return entities.select(F.col("g").alias("group"), F.col("best.id").alias("row_id"), F.col("best.s").alias("string"), F.col("best.weight").alias("count"), "strings")


def best_representatives(df: DataFrame, **columns: str) -> DataFrame:
    """The survivors, with the posterior of each one's value under the sources' fitted quality: (group, row_id, string, count, strings, truth)."""
    _, entities, q = _fit(df, columns)
    return entities.select(
        F.col("g").alias("group"), F.col("best.id").alias("row_id"), F.col("best.s").alias("string"), F.col("best.weight").alias("count"), "strings",
        F.round(q.posterior(F.col("best.feeds"), F.col("covering")), 6).alias("truth"),
    )


def judged_representatives(df: DataFrame, **columns: str) -> DataFrame:
    """The survivor that the model decides on, one row for each group of two or more strings: (group, row_id, string, count, truth).

    string is the value of greatest posterior under the sources' fitted quality; ties go to the greater sum of count, then to the
    first string. row_id is its best row.
    """
    values, entities, q = _fit(df, columns)
    every = join_unique(values, entities.select("g", "covering", "strings"), ["g"], "strings")
    every = every.withColumn("truth", F.round(q.posterior(F.col("feeds"), F.col("covering")), 6))
    best = F.min_by(F.struct("id", "s", "weight", "truth"), F.struct(-F.col("truth"), -F.col("weight"), F.col("s"))).alias("best")
    chosen = every.groupBy("g").agg(best)
    return chosen.select(F.col("g").alias("group"), F.col("best.id").alias("row_id"), F.col("best.s").alias("string"), F.col("best.weight").alias("count"), "best.truth")


def judged_values(df: DataFrame, **columns: str) -> DataFrame:
    """(group, string, count, truth): every value judged true of each entity of several values, one row each, and always the chosen one."""
    values, entities, q = _fit(df, columns)
    every = join_unique(values, entities.select("g", "covering", "strings", F.col("best.s").alias("chosen")), ["g"], "strings")
    every = every.withColumn("truth", F.round(q.posterior(F.col("feeds"), F.col("covering")), 6))
    return every.where((F.col("truth") >= 0.5) | (F.col("s") == F.col("chosen"))).select(F.col("g").alias("group"), F.col("s").alias("string"), F.col("weight").alias("count"), "truth")


def source_quality(df: DataFrame, **columns: str) -> DataFrame:
    """(feed, sensitivity, specificity), one row a source."""
    q = _fit(df, columns)[2]
    rows = [(f, round(q.sens[f], 6), round(q.spec[f], 6)) for f in sorted(q.sens)]
    return df.sparkSession.createDataFrame(rows, "feed string, sensitivity double, specificity double")

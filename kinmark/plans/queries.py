"""Queries over the test tables, one or more for each operator, with the SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import ALWAYS, l2_normalize, pair_loss, score, score_to_cos, weight
from ..functions.text import COMPANY_FORMS, INNER_MARKS, SEPARATORS, augmented, one_of, simplify, simplify_corp, suffix_key
from ..operators import calibrate, clustering, evaluate, groups, linkage, review, spelling, vectors
from .storage import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ALPHA, THRESHOLD, SEED = 2.0, 0.2725, 42
COS = score_to_cos(THRESHOLD, ALPHA)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- group tables -------------------------------------------------------------------------------------------------------


def matches(spark: SparkSession, d: str, pick: Callable[[str], Column] = F.min, where: str = "true") -> DataFrame:
    """A group table of the strings of matcher that have a group, each in its first (or last) one."""
    rows = table(spark, d, "matcher").where("string is not null and `group` is not null").where(where)
    return groups.relabel(rows.groupBy("string").agg(F.sum(F.coalesce("count", F.lit(1))).alias("count"), pick("group").alias("group")))


def strings(spark: SparkSession, d: str) -> DataFrame:
    return groups.from_strings(table(spark, d, "matcher"), "string", "count")


def listed(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    rows = table(spark, d, "link_sets")
    return rows if kind is None else rows.where(F.lower("kind") == kind)


def labels(rows: str, by: str) -> str:
    """SQL for canonical labels of the rows (string, n, by)."""
    return f"""SELECT string, CAST(n AS BIGINT) AS "count", label AS "group" FROM ({rows}) JOIN
        (SELECT {by}, arg_min(string, {{'a': -n, 'b': string}}) AS label FROM ({rows}) GROUP BY {by}) USING ({by})"""


def base(pick: str = "min", where: str = "true") -> str:
    return labels(f'SELECT string, sum(coalesce("count", 1)) AS n, {pick}("group") AS g FROM matcher WHERE string IS NOT NULL AND "group" IS NOT NULL AND {where} GROUP BY string', "g")


def reach(edges: str) -> str:
    """SQL for (a, root) of the components of edges (a, b); root is the smallest member."""
    return f"""(WITH RECURSIVE x AS (SELECT DISTINCT a, b FROM ({edges}) WHERE a <> b), e AS (SELECT a, b FROM x UNION SELECT b, a FROM x),
        r(a, root) USING KEY (a) AS (SELECT a, min(least(a, b)) FROM e GROUP BY a
          UNION SELECT e.a, min(r.root) FROM e JOIN recurring.r AS r ON r.a = e.b JOIN recurring.r AS own ON own.a = e.a WHERE r.root < own.root GROUP BY e.a)
        SELECT a, root FROM r)"""


def united(start: str, links: str) -> str:
    """SQL for unite_links of start with links (key, string)."""
    touched = f'SELECT DISTINCT key, "group" AS g FROM ({links}) JOIN ({start}) USING (string) WHERE key IS NOT NULL'
    edges = f"SELECT g AS a, min(g) OVER (PARTITION BY key) AS b FROM ({touched})"
    rows = f'SELECT string, "count" AS n, coalesce(root, "group") AS g FROM ({start}) LEFT JOIN {reach(edges)} ON a = "group"'
    return labels(rows, "g")


SETS = "SELECT DISTINCT string FROM link_sets"
SINGLE = 'SELECT string, CAST(sum(coalesce("count", 1)) AS BIGINT) AS "count", string AS "group" FROM matcher WHERE string IS NOT NULL GROUP BY string'
GAPS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def quoted(marks: str) -> str:
    return one_of(marks).replace("'", "''")


def simplified(s: str) -> str:
    """SQL for simplify, without lookaround: inner marks go in passes."""
    out = f"replace(lower({s}), ' & ', ' and ')"
    for _ in range(4):
        out = f"regexp_replace({out}, '([^{GAPS}])[{quoted(INNER_MARKS)}]([^{GAPS}])', '\\1\\2', 'g')"
    return f"trim(regexp_replace({out}, '[{GAPS}{quoted(SEPARATORS)}]+', ' ', 'g'))"


def corp(s: str) -> str:
    forms = "|".join(sorted(COMPANY_FORMS, key=lambda w: (-len(w), w)))
    return f"regexp_replace(regexp_replace({simplified(s)}, '^the ', ''), '( ({forms}))+$', '')"


@query('SELECT string, CAST(sum(coalesce("count", 1)) AS BIGINT) AS "count", string AS "group" FROM matcher WHERE string IS NOT NULL GROUP BY string')
def string_counts(spark: SparkSession, d: str) -> DataFrame:
    return strings(spark, d)


@query(base())
def group_labels(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d)


@query(f'SELECT "group", count(*) AS strings, CAST(sum("count") AS BIGINT) AS total FROM ({base()}) GROUP BY "group"')
def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return groups.group_sizes(matches(spark, d))


RAW = 'SELECT string, "group" AS g FROM matcher WHERE string IS NOT NULL AND "group" IS NOT NULL'


@query(labels(f'SELECT string, n, coalesce(root, f) AS g FROM (SELECT string, sum(coalesce("count", 1)) AS n, min("group") AS f FROM matcher WHERE string IS NOT NULL AND "group" IS NOT NULL GROUP BY string) LEFT JOIN {reach(f"SELECT g AS a, min(g) OVER (PARTITION BY string) AS b FROM ({RAW})")} ON a = f', "g"))
def from_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.from_table(table(spark, d, "matcher").where("`group` is not null").select("string", "count", "group"))


PAIR = "SELECT string0 AS a, string1 AS b FROM pair_links WHERE string1 IS NOT NULL"


@query(labels(f"SELECT string, n, coalesce(root, string) AS g FROM (SELECT string, count(*) AS n FROM (SELECT string0 AS string FROM pair_links UNION ALL SELECT string1 FROM pair_links) WHERE string IS NOT NULL GROUP BY string) LEFT JOIN {reach(PAIR)} ON a = string", "g"))
def from_pairs(spark: SparkSession, d: str) -> DataFrame:
    return groups.from_table(table(spark, d, "pair_links").select("string0", "string1"))


@query(base())
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.tables import read_csv, write_csv

    path = f"{Scratch(spark).root}/csv"
    write_csv(matches(spark, d), path)
    return read_csv(spark, path)


@query(base())
def to_df_sorted(spark: SparkSession, d: str) -> DataFrame:
    return groups.to_table(matches(spark, d))


@query(f'SELECT string, "count", "group" FROM (SELECT *, count(*) OVER (PARTITION BY "group") AS k FROM ({base()})) WHERE k > 1')
def to_df_no_singletons(spark: SparkSession, d: str) -> DataFrame:
    return groups.to_table(matches(spark, d), singletons=False)


@query(f'SELECT pair_id, string0, "group" AS label FROM pair_links LEFT JOIN ({base()}) ON string = string0')
def lookup_labels(spark: SparkSession, d: str) -> DataFrame:
    return groups.lookup(matches(spark, d), table(spark, d, "pair_links").select("pair_id", "string0"), "string0", strict=False)


@query(f'WITH m AS ({base()}) SELECT * FROM m WHERE "group" IN (SELECT "group" FROM m JOIN ({SETS}) USING (string))')
def matched_to(spark: SparkSession, d: str) -> DataFrame:
    return groups.matched_to(matches(spark, d), listed(spark, d).select("string"))


@query(labels(f'SELECT string, "count" AS n, "group" AS g FROM ({base()}) WHERE string IN ({SETS})', "g"))
def keep_strings(spark: SparkSession, d: str) -> DataFrame:
    return groups.keep(matches(spark, d), listed(spark, d).select("string"))


@query(labels(f'SELECT string, "count" AS n, "group" AS g FROM ({base()}) WHERE string NOT IN ({SETS})', "g"))
def drop_strings(spark: SparkSession, d: str) -> DataFrame:
    return groups.drop(matches(spark, d), listed(spark, d).select("string"), strict=False)


@query(labels(f'SELECT string, "count" AS n, CASE WHEN string IN ({SETS}) THEN \'=\' || string ELSE \'+\' || "group" END AS g FROM ({base()})', "g"))
def split_strings(spark: SparkSession, d: str) -> DataFrame:
    return groups.split(matches(spark, d), listed(spark, d).select("string"), strict=False)


@query(f'SELECT string, "count", string AS "group" FROM ({base()})')
def split_all(spark: SparkSession, d: str) -> DataFrame:
    return groups.split_all(matches(spark, d))


@query(labels(f'SELECT string, 1 AS n, "group" AS g FROM ({base()})', "g"))
def reset_counts(spark: SparkSession, d: str) -> DataFrame:
    return groups.reset_counts(matches(spark, d))


@query(labels(f"""SELECT string, sum(n) AS n, arg_min(g, k) AS g FROM (SELECT string, "count" AS n, "group" AS g, 0 AS k FROM ({base()})
    UNION ALL SELECT string0, count(*), string0, 1 FROM pair_links GROUP BY string0) GROUP BY string""", "g"))  # fmt: skip
def add_strings(spark: SparkSession, d: str) -> DataFrame:
    return groups.add_strings(matches(spark, d), table(spark, d, "pair_links"), "string0")


@query(united(base(), "SELECT 'all' AS key, string FROM link_sets WHERE lower(kind) = 'never'"))
def unite_list(spark: SparkSession, d: str) -> DataFrame:
    return groups.unite_strings(matches(spark, d), listed(spark, d, "never").select("string"))


@query(united(base(), "SELECT set_id AS key, string FROM link_sets WHERE lower(kind) = 'always'"))
def unite_nested(spark: SparkSession, d: str) -> DataFrame:
    return groups.unite_sets(matches(spark, d), listed(spark, d, "always"))


@query(united(base(), "SELECT group0 AS key, string0 AS string FROM pair_links"))
def unite_mapping(spark: SparkSession, d: str) -> DataFrame:
    return groups.unite_mapping(matches(spark, d), table(spark, d, "pair_links").select(F.col("string0").alias("string"), F.col("group0").alias("label")))


@query(labels(f'SELECT string, "count" AS n, {corp("string")} AS g FROM ({SINGLE})', "g"))
def unite_simplify_corp(spark: SparkSession, d: str) -> DataFrame:
    return groups.group_by_key(strings(spark, d), simplify_corp)


@query(united(base(), f"SELECT {corp('string')} AS key, string FROM ({base()})"))
def unite_key_on_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.unite_key(matches(spark, d), simplify_corp)


@query(labels(f'SELECT string, "count" AS n, right(string, 3) AS g FROM ({SINGLE})', "g"))
def unite_suffix_key(spark: SparkSession, d: str) -> DataFrame:
    return groups.group_by_key(strings(spark, d), suffix_key)


@query(united(base(), f'SELECT "group" AS key, string FROM ({base("max")})'))
def unite_partitions(spark: SparkSession, d: str) -> DataFrame:
    return groups.unite_partition(matches(spark, d), matches(spark, d, F.max))


HALF = "feed IN ('registry', 'scan', 'web_form')"
ADDED = labels(f"""SELECT string, sum(n) AS n, arg_min(g, k) AS g FROM (SELECT string, "count" AS n, "group" AS g, 0 AS k FROM ({base(where=HALF)})
    UNION ALL SELECT string, "count", string, 1 FROM ({base(where="NOT " + HALF)})) GROUP BY string""", "g")  # fmt: skip


@query(united(ADDED, f'SELECT "group" AS key, string FROM ({base(where="NOT " + HALF)})'))
def add_partitions(spark: SparkSession, d: str) -> DataFrame:
    return groups.add_partitions(matches(spark, d, where=HALF), matches(spark, d, where="NOT " + HALF))


@query(f"SELECT row_id, {simplified('string')} AS simple FROM matcher")
def simplify_strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "matcher").select("row_id", simplify("string").alias("simple"))


@query(f"SELECT row_id, {corp('string')} AS simple FROM matcher")
def simplify_corp_strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "matcher").select("row_id", simplify_corp("string").alias("simple"))


# --- merges -------------------------------------------------------------------------------------------------------------


def _merge(spark: SparkSession, d: str, how: str) -> DataFrame:
    nation = table(spark, d, "nation")
    part = nation.where("n_name < 'S'").select(F.col("n_name").alias("string"), F.col("n_nationkey").alias("count"), F.col("n_regionkey").alias("group"))
    sup = table(spark, d, "supplier").join(nation, F.expr("s_nationkey = n_nationkey")).where("n_name < 'P' or n_name >= 'S'").select("s_suppkey", F.col("n_name").alias("place"))
    cus = table(spark, d, "customer").join(nation, F.expr("c_nationkey = n_nationkey")).where("n_name > 'F'").groupBy(F.col("n_name").alias("home"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"))
    return linkage.merge_tables(sup, cus, groups.relabel(part), how, left_on="place", right_on="home").select("s_suppkey", "place", "match_group", "home", "segment", "customers")


def _merge_sql(how: str) -> str:
    part = labels("SELECT n_name AS string, n_nationkey AS n, n_regionkey AS g FROM nation WHERE n_name < 'S'", "g")
    return f"""WITH p AS ({part}),
        l AS (SELECT s_suppkey, n_name AS place, p."group" AS g FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN p ON string = n_name WHERE n_name < 'P' OR n_name >= 'S'),
        r AS (SELECT n_name AS home, c_mktsegment AS segment, count(*) AS customers, any_value(p."group") AS g FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN p ON string = n_name WHERE n_name > 'F' GROUP BY 1, 2)
        SELECT s_suppkey, place, l.g AS match_group, home, segment, customers FROM l {how} JOIN r ON l.g IS NOT DISTINCT FROM r.g"""


@query(_merge_sql("INNER"))
def merge_inner(spark: SparkSession, d: str) -> DataFrame:
    return _merge(spark, d, "inner")


@query(_merge_sql("LEFT"))
def merge_left(spark: SparkSession, d: str) -> DataFrame:
    return _merge(spark, d, "left")


@query(_merge_sql("RIGHT"))
def merge_right(spark: SparkSession, d: str) -> DataFrame:
    return _merge(spark, d, "right")


@query(_merge_sql("FULL"))
def merge_outer(spark: SparkSession, d: str) -> DataFrame:
    return _merge(spark, d, "outer")


# --- vectors ------------------------------------------------------------------------------------------------------------


def units(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("string"), "embedding", (F.col("vec_id") % 5 + 1).alias("count"))
    return vectors.unit_vectors(e, "string", "embedding", "count")


def gold(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return groups.relabel(e.select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("string"), (F.col("vec_id") % 5 + 1).alias("count"), F.col("label").alias("group")))


U = """SELECT string, n, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM
    (SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS string, vec_id % 5 + 1 AS n, label, embedding::DOUBLE[] AS v FROM embeddings)"""
GOLD = labels("SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS string, vec_id % 5 + 1 AS n, label AS g FROM embeddings", "g")
PAIRS = f"SELECT a.string AS string0, b.string AS string1, list_inner_product(a.u, b.u) AS cos FROM u a JOIN u b ON a.string < b.string WHERE list_inner_product(a.u, b.u) >= {COS!r}"
SCORE = f"least(1, exp(-{ALPHA} * (1 - cos)))"
Z = f"greatest({ALPHA} * (1 - cos), 1e-6)"
LOSS = f"CASE WHEN group0 = group1 THEN {Z} ELSE -ln(1 - exp(-{Z})) END"
SCORED = f"""WITH u AS ({U}), g AS ({GOLD}), p AS ({PAIRS}), s AS (SELECT string0, string1, cos, x."group" AS group0, y."group" AS group1 FROM p JOIN g x ON x.string = string0 JOIN g y ON y.string = string1),
    scored AS (SELECT string0, string1, group0, group1, {SCORE} AS score, {LOSS} AS loss FROM s)"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _scored(spark: SparkSession, d: str, **bounds) -> DataFrame:
    return vectors.scored_pairs(units(spark, d), gold(spark, d), ALPHA, **({"min_score": THRESHOLD} | bounds))


@query("SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS string, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)) AS v FROM embeddings")
def l2_normalized(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("string"), l2_normalize(F.col("embedding")).alias("v"))
    return e.select("string", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query(f"WITH u AS ({U}) SELECT string0, string1, round(cos, 6) AS cos FROM ({PAIRS})")
def pairs_cosine(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.similar_pairs(units(spark, d), COS), "cos")


TARGET = "label = 0"


@query(f"""WITH u AS ({U}) SELECT string, arg_min(target, {{'a': -round(cos, 12), 'b': target}}) AS target, round(max(cos), 6) AS cos FROM
    (SELECT a.string, b.string AS target, list_inner_product(a.u, b.u) AS cos FROM u a JOIN u b ON a.label <> 0 AND b.label = 0) GROUP BY string""")
def nearest_target(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "embeddings").where(TARGET).select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("string"))
    u = units(spark, d)
    return rounded(vectors.nearest_target(u.join(ids, "string", "left_anti"), u.join(ids, "string", "left_semi")), "cos")


@query(f"WITH u AS ({U}), p AS (SELECT string AS string0, lead(string) OVER (ORDER BY string) AS string1 FROM u) SELECT string0, string1, round(cos, 6) AS cos, round({SCORE}, 6) AS score FROM (SELECT string0, string1, list_inner_product(a.u, b.u) AS cos FROM p JOIN u a ON a.string = string0 JOIN u b ON b.string = string1)")
def score_pairs(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "embeddings").select("vec_id")
    follows = ids.select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("string0"), F.lpad((F.col("vec_id") + 1).cast("string"), 8, "0").alias("string1"))
    return rounded(vectors.score_pairs(follows, units(spark, d), ALPHA), "cos", "score")


@query(f"{SCORED} SELECT string0, string1, group0, group1, round(score, 6) AS score, round(loss, 6) AS loss FROM scored")
def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_scored(spark, d), "score", "loss")


@query(f"{SCORED} SELECT string0, string1, group0, group1, round(score, 6) AS score, round(loss, 6) AS loss FROM scored WHERE group0 <> group1 AND score >= 0.28 AND score <= 0.31 AND loss >= 0.33 AND loss <= 0.4")
def pairs_filtered(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_scored(spark, d, min_score=0.28, max_score=0.31, min_loss=0.33, max_loss=0.4, is_match=False), "score", "loss")


@query(f"{SCORED} SELECT string0, string1, round(sqrt(x.n) * sqrt(y.n) * loss * loss, 6) AS loss FROM scored JOIN u x ON x.string = string0 JOIN u y ON y.string = string1")
def pair_losses(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    w = lambda k: u.select(F.col("string").alias(f"string{k}"), weight(F.col("count")).alias(f"w{k}"))
    g = gold(spark, d)
    of = lambda k: g.select(F.col("string").alias(f"string{k}"), F.col("group").alias(f"g{k}"))
    rows = vectors.similar_pairs(u, COS).join(w(0), "string0").join(w(1), "string1").join(of(0), "string0").join(of(1), "string1")
    return rounded(rows.select("string0", "string1", pair_loss(F.col("cos"), F.expr("g0 = g1"), ALPHA, F.col("w0"), F.col("w1")).alias("loss")), "loss")


@query(f"""{SCORED}, e AS (SELECT string0 AS string, string1 AS other, loss FROM scored UNION ALL SELECT string1, string0, loss FROM scored)
    SELECT string, arg_min(other, {{'a': -round(loss, 9), 'b': other}}) AS other, round(max(loss), 6) AS loss FROM e GROUP BY string""")
def hardest_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.hardest_pairs(_scored(spark, d)), "loss")


TOP = f"""{SCORED}, k AS (SELECT "group", count(*) AS k FROM g GROUP BY 1), i AS (SELECT scored.*, x.k * y.k AS impact FROM scored JOIN k x ON x."group" = group0 JOIN k y ON y."group" = group1 WHERE group0 <> group1)"""
BY_IMPACT = "impact DESC, round(score, 9) DESC, string0, string1"


@query(f"{TOP} SELECT string0, string1, group0, group1, round(score, 6) AS score, round(loss, 6) AS loss, impact FROM i QUALIFY row_number() OVER (PARTITION BY least(group0, group1), greatest(group0, group1) ORDER BY {BY_IMPACT}) = 1 ORDER BY {BY_IMPACT.replace('score', 'i.score')} LIMIT 100")
def top_scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(review.top_scored_pairs(_scored(spark, d), gold(spark, d), 100), "score", "loss")


@query(f"{TOP} SELECT string0, string1, group0, group1, round(score, 6) AS score, round(loss, 6) AS loss, impact FROM i ORDER BY {BY_IMPACT.replace('score', 'i.score')} LIMIT 100")
def top_pairs_by_string(spark: SparkSession, d: str) -> DataFrame:
    return rounded(review.top_scored_pairs(_scored(spark, d), gold(spark, d), 100, by_group=False), "score", "loss")


@query(f"{TOP} SELECT string0, string1, group0, group1, round(score, 6) AS score, round(loss, 6) AS loss, impact FROM i WHERE score < 0.28 ORDER BY {BY_IMPACT.replace('score', 'i.score')} LIMIT 100")
def top_pairs_skip(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    skip = s.where("score >= 0.28").select(F.col("string1").alias("string0"), F.col("string0").alias("string1"))
    return rounded(review.top_scored_pairs(s, gold(spark, d), 100, by_group=False, skip=skip), "score", "loss")


GRID = [0.5, 1.0, 2.0, 4.0, 8.0]


@query("\nUNION ALL ".join(f"SELECT {a!r}::DOUBLE AS alpha, round(avg(CASE WHEN group0 = group1 THEN greatest({a} * (1 - cos), 1e-6) ELSE -ln(1 - exp(-greatest({a} * (1 - cos), 1e-6))) END), 6) AS loss FROM ({SCORED} SELECT * FROM s)" for a in GRID))
def alpha_losses(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d)
    of = lambda k: g.select(F.col("string").alias(f"string{k}"), F.col("group").alias(f"g{k}"))
    pairs = vectors.similar_pairs(units(spark, d), COS).join(of(0), "string0").join(of(1), "string1").select("cos", F.expr("g0 = g1").alias("same"))
    return rounded(calibrate.alpha_losses(pairs, GRID), "loss")


# --- over all pairs -----------------------------------------------------------------------------------------------------
# The queries above hold the pairs of at least THRESHOLD, as their SQL says; hard pairs, calibration and review are of all.

FULL = PAIRS[: PAIRS.index(" WHERE ")]
EVERY = SCORED.replace(PAIRS, FULL)


@query(f"{EVERY} SELECT string0, string1, round(sqrt(x.n) * sqrt(y.n) * loss * loss, 6) AS loss FROM scored JOIN u x ON x.string = string0 JOIN u y ON y.string = string1")
def pair_losses_all(spark: SparkSession, d: str) -> DataFrame:
    u, g = units(spark, d), gold(spark, d)
    of = lambda k: g.select(F.col("string").alias(f"string{k}"), F.col("group").alias(f"g{k}"), weight(F.col("count")).alias(f"w{k}"))
    rows = vectors.similar_pairs(u, ALWAYS).join(of(0), "string0").join(of(1), "string1")
    return rounded(rows.select("string0", "string1", pair_loss(F.col("cos"), F.expr("g0 = g1"), ALPHA, F.col("w0"), F.col("w1")).alias("loss")), "loss")


@query(f"""{EVERY}, e AS (SELECT string0 AS string, string1 AS other, loss FROM scored UNION ALL SELECT string1, string0, loss FROM scored)
    SELECT string, arg_min(other, {{'a': -round(loss, 9), 'b': other}}) AS other, round(max(loss), 6) AS loss FROM e GROUP BY string""")
def hardest_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.hardest_of_all(units(spark, d), gold(spark, d), ALPHA), "loss")


@query(f"{TOP.replace(SCORED, EVERY)} SELECT string0, string1, group0, group1, round(score, 6) AS score, round(loss, 6) AS loss, impact FROM i QUALIFY row_number() OVER (PARTITION BY least(group0, group1), greatest(group0, group1) ORDER BY {BY_IMPACT}) = 1 ORDER BY {BY_IMPACT.replace('score', 'i.score')} LIMIT 100")
def top_scored_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.top_of_all(units(spark, d), gold(spark, d), ALPHA, 100), "score", "loss")


@query(f"{TOP.replace(SCORED, EVERY)} SELECT string0, string1, group0, group1, round(score, 6) AS score, round(loss, 6) AS loss, impact FROM i ORDER BY {BY_IMPACT.replace('score', 'i.score')} LIMIT 100")
def top_pairs_by_string_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.top_of_all(units(spark, d), gold(spark, d), ALPHA, 100, by_group=False), "score", "loss")


@query("\nUNION ALL ".join(f"SELECT {a!r}::DOUBLE AS alpha, round(avg(CASE WHEN group0 = group1 THEN greatest({a} * (1 - cos), 1e-6) ELSE -ln(1 - exp(-greatest({a} * (1 - cos), 1e-6))) END), 6) AS loss FROM ({EVERY} SELECT * FROM s)" for a in GRID))
def alpha_losses_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.mean_losses_of_all(units(spark, d), gold(spark, d), GRID), "loss")


# --- clusters -----------------------------------------------------------------------------------------------------------

FAST = f"(WITH u AS ({U}) {labels(f'SELECT string, n, coalesce(root, string) AS g FROM u LEFT JOIN {reach(f"SELECT string0 AS a, string1 AS b FROM ({PAIRS})")} ON a = string', 'g')})"
PAIRED = "SELECT vec_id // 2 AS set_id, lpad(CAST(vec_id AS VARCHAR), 8, '0') AS string FROM embeddings WHERE label = 1"


def _sets(spark: SparkSession, d: str, label: int, size: int) -> DataFrame:
    e = table(spark, d, "embeddings").where(F.col("label") == label)
    return e.select(F.floor(F.col("vec_id") / size).alias("set_id"), F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("string"))


@query(f"SELECT * FROM {FAST}")
def unite_similar_fast(spark: SparkSession, d: str) -> DataFrame:
    return clustering.unite_similar(units(spark, d), THRESHOLD, ALPHA)


@query(f"""WITH u AS ({U}) {labels(f'''SELECT string, n, coalesce(root, string) AS g FROM u LEFT JOIN {reach(f"SELECT string0 AS a, string1 AS b FROM ({PAIRS}) UNION ALL SELECT string, min(string) OVER (PARTITION BY set_id) FROM ({PAIRED})")} ON a = string''', 'g')}""")
def unite_similar_always(spark: SparkSession, d: str) -> DataFrame:
    return clustering.unite_similar(units(spark, d), THRESHOLD, ALPHA, always=_sets(spark, d, 1, 2))

def greedy(refused: str, never: str = "SELECT NULL::VARCHAR AS string, NULL::BIGINT AS set_id WHERE false", near: float = -2.0, where: str = "true") -> str:
    """SQL for constrained agglomeration, one pair after the other from the most similar on: (k, a, b, took, na, nb, g) of each step,
    g being the groups of all strings after it. Places of strings stand for them; refused says of groups ma and mb that they stay apart."""
    return f"""(WITH RECURSIVE u AS ({U}), n AS (SELECT *, row_number() OVER (ORDER BY string) AS i FROM u), p AS ({PAIRS}),
        e AS (SELECT x.i AS a, y.i AS b, row_number() OVER (ORDER BY cos DESC, string0, string1) AS k FROM p JOIN n x ON x.string = string0 JOIN n y ON y.string = string1 WHERE {where}),
        s AS (SELECT i, coalesce(list(DISTINCT set_id) FILTER (set_id IS NOT NULL), []) AS never FROM n LEFT JOIN ({never}) v ON v.string = n.string GROUP BY i),
        t AS (SELECT a.i, list(b.i) AS near FROM n a JOIN n b ON list_inner_product(a.u, b.u) >= {near!r} GROUP BY a.i),
        c AS (SELECT list(i ORDER BY i) AS idx, list(n.n ORDER BY i) AS num, list(never ORDER BY i) AS never, list(near ORDER BY i) AS near FROM n JOIN s USING (i) JOIN t USING (i)),
        r AS (SELECT 0::BIGINT AS k, 0::BIGINT AS a, 0::BIGINT AS b, false AS took, 0::HUGEINT AS na, 0::HUGEINT AS nb, idx AS g FROM c
          UNION ALL SELECT k, a, b, took, list_sum(list_transform(ma, lambda x: num[x]))::HUGEINT, list_sum(list_transform(mb, lambda x: num[x]))::HUGEINT,
              CASE WHEN took THEN list_transform(g, lambda x: CASE WHEN x = g[b] THEN g[a] ELSE x END) ELSE g END
            FROM (SELECT *, g[a] <> g[b] AND NOT ({refused}) AS took FROM
              (SELECT e.k, e.a, e.b, r.g, c.num, c.never, c.near, list_filter(c.idx, lambda x: r.g[x] = r.g[e.a]) AS ma, list_filter(c.idx, lambda x: r.g[x] = r.g[e.b]) AS mb FROM r JOIN e ON e.k = r.k + 1, c)))
        SELECT * FROM r)"""


NEVER = "list_has_any(flatten(list_transform(ma, lambda x: never[x])), flatten(list_transform(mb, lambda x: never[x])))"
FAR = "len(ma) + len(mb) > 2 AND NOT list_bool_and(list_transform(ma, lambda x: len(list_intersect(near[x], mb)) = len(mb)))"
NAMED = f"SELECT string, n, row_number() OVER (ORDER BY string) AS i FROM ({U})"


def grouped(steps: str) -> str:
    """SQL for the group table that the last of the steps leaves."""
    rows = f"SELECT string, n, g[i] AS g FROM ({NAMED}), (SELECT g FROM {steps} ORDER BY k DESC LIMIT 1)"
    return labels(rows, "g")


def sets_of(label: int, size: int) -> str:
    return f"SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS string, vec_id // {size} AS set_id FROM embeddings WHERE label = {label}"


NEVER_BY_LABEL = f"""SELECT m.string, v.set_id FROM ({sets_of(1, 100)}) v JOIN (SELECT string, min(string) OVER (PARTITION BY set_id) AS l FROM ({PAIRED})) x ON x.string = v.string
    JOIN (SELECT string, min(string) OVER (PARTITION BY set_id) AS l FROM ({PAIRED})) m ON m.l = x.l"""


@query(grouped(greedy(FAR, near=score_to_cos(0.28, ALPHA))))
def unite_similar_group_threshold(spark: SparkSession, d: str) -> DataFrame:
    return clustering.unite_similar(units(spark, d), THRESHOLD, ALPHA, group_threshold=0.28)


@query(grouped(greedy(NEVER, never=sets_of(2, 100))))
def unite_similar_never(spark: SparkSession, d: str) -> DataFrame:
    return clustering.unite_similar(units(spark, d), THRESHOLD, ALPHA, never=_sets(spark, d, 2, 100))


@query(united(grouped(greedy(NEVER, never=NEVER_BY_LABEL)), f"SELECT set_id AS key, string FROM ({PAIRED})"))
def unite_similar_always_never(spark: SparkSession, d: str) -> DataFrame:
    return clustering.unite_similar(units(spark, d), THRESHOLD, ALPHA, always=_sets(spark, d, 1, 2), never=_sets(spark, d, 1, 100))


@query(f"""WITH u AS ({U}), n AS ({NAMED}), l AS (SELECT string, coalesce(set_id, -CAST(string AS BIGINT) - 1) AS l FROM u LEFT JOIN ({PAIRED}) USING (string))
    SELECT x.string AS i, y.string AS j, CAST(na AS BIGINT) AS n_i, CAST(nb AS BIGINT) AS n_j, round(least(1, exp(-{ALPHA} * (1 - list_inner_product(ux.u, uy.u)))), 6) AS score, lx.l = ly.l AS always_match
    FROM {greedy("false")} JOIN n x ON x.i = a JOIN n y ON y.i = b JOIN u ux ON ux.string = x.string JOIN u uy ON uy.string = y.string JOIN l lx ON lx.string = x.string JOIN l ly ON ly.string = y.string WHERE took""")
def united_pairs_log(spark: SparkSession, d: str) -> DataFrame:
    log = clustering.united_pairs(units(spark, d), THRESHOLD, ALPHA, always=_sets(spark, d, 1, 2))
    return log.select("i", "j", "n_i", "n_j", F.round(score(F.col("cos"), ALPHA), 6).alias("score"), "always_match")


@query(f"""WITH a AS ({PAIRED}), l AS (SELECT string, min(string) OVER (PARTITION BY set_id) AS s, arg_max(string, {{'n': CAST(string AS BIGINT) % 5, 'b': -CAST(string AS BIGINT)}}) OVER (PARTITION BY set_id) AS label FROM a),
    v AS (SELECT CAST(string AS BIGINT) // 100 AS k, string, label FROM l), bad AS (SELECT k FROM v GROUP BY k HAVING count(DISTINCT label) < count(*))
    SELECT string, k AS never_match_group, label AS always_match_group FROM v JOIN bad USING (k)""")
def always_never_conflicts(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    return clustering.always_never_conflicts(u.select("string", "count", F.col("string").alias("group")), _sets(spark, d, 1, 2), _sets(spark, d, 1, 100))


@query(labels(f"""SELECT m.string, m."count" AS n, coalesce(t."group", m."group") AS g FROM ({GOLD}) m LEFT JOIN
    (WITH u AS ({U}) SELECT string, arg_min(target, {{'a': -round(cos, 12), 'b': target}}) AS target FROM
       (SELECT a.string, b.string AS target, list_inner_product(a.u, b.u) AS cos FROM u a JOIN u b ON a.label <> 0 AND b.label = 0) GROUP BY string HAVING max(cos) > {COS!r}) n ON n.string = m.string
    LEFT JOIN ({GOLD}) t ON t.string = n.target""", "g"))  # fmt: skip
def unite_nearest(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "embeddings").where(TARGET).select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("string"))
    return clustering.unite_nearest(gold(spark, d), units(spark, d), ids, THRESHOLD, ALPHA)


APART = "SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS string FROM embeddings WHERE label = 3"
HIT = f"""SELECT string, "group" AS g FROM {FAST} WHERE "group" IN (SELECT "group" FROM {FAST} JOIN ({APART}) USING (string) GROUP BY 1 HAVING count(*) > 1)"""
WITHIN = greedy(NEVER, never=f"SELECT string, dense_rank() OVER (ORDER BY g) AS set_id FROM ({HIT}) JOIN ({APART}) USING (string)", where=f"(SELECT count(DISTINCT h.g) = 1 AND count(*) = 2 FROM ({HIT}) h WHERE h.string IN (string0, string1))")


@query(labels(f"""SELECT f.string, f."count" AS n, CASE WHEN h.string IS NULL THEN 'kept ' || f."group" ELSE 'new ' || CAST(w.g AS VARCHAR) END AS g FROM {FAST} f LEFT JOIN ({HIT}) h ON h.string = f.string
    JOIN (SELECT string, g[i] AS g FROM ({NAMED}), (SELECT g FROM {WITHIN} ORDER BY k DESC LIMIT 1)) w ON w.string = f.string""", "g"))  # fmt: skip
def separate(spark: SparkSession, d: str) -> DataFrame:
    apart = table(spark, d, "embeddings").where("label = 3").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("string"))
    found = Scratch(spark).write(clustering.unite_similar(units(spark, d), THRESHOLD, ALPHA))
    return clustering.separate(found, units(spark, d), apart, THRESHOLD, ALPHA)


# --- stored vectors, link sets and links of the project -------------------------------------------------------------------

#: A stored vector is usable where it has 64 finite numbers that aren't all zero; a string has its first usable one.
USABLE = "v IS NOT NULL AND len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0"
STORED_SQL = f"""SELECT string, n, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM
    (SELECT string, greatest(coalesce("count", 1), 1) AS n, v::DOUBLE[] AS v FROM stored_vectors WHERE {USABLE} QUALIFY row_number() OVER (PARTITION BY string ORDER BY vec_id) = 1)"""
CLOSE = 0.9


def stored_rows(spark: SparkSession, d: str) -> DataFrame:
    """(string, count, v) of the stored vectors: the first usable one of each string, as it is stored."""
    rows = table(spark, d, "stored_vectors").where((F.size("v") == 64) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    first = rows.groupBy("string").agg(F.min_by(F.struct("v", F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)).alias("n")), "vec_id").alias("b"))
    return first.select("string", F.col("b.n").alias("count"), "b.v").where("string is not null")


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The same at length one."""
    return vectors.unit_vectors(stored_rows(spark, d), "string", "v", "count")


def near(limit: str, u: str = STORED_SQL) -> str:
    return f"WITH u AS MATERIALIZED ({u}) SELECT a.string AS string0, b.string AS string1, list_inner_product(a.u, b.u) AS cos FROM u a JOIN u b ON a.string < b.string WHERE list_inner_product(a.u, b.u) >= {limit}"


@query(f"SELECT string0, string1, round(cos, 6) AS cos FROM ({near(repr(CLOSE))})")
def stored_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.similar_pairs(stored_rows(spark, d), CLOSE, unit=True), "cos")


@query(labels(f"SELECT string, n, coalesce(root, string) AS g FROM ({STORED_SQL}) LEFT JOIN {reach(f'SELECT string0 AS a, string1 AS b FROM ({near(repr(CLOSE))})')} ON a = string", "g"))
def stored_unite_similar(spark: SparkSession, d: str) -> DataFrame:
    return clustering.unite_similar(stored_rows(spark, d), 1 / math.e, 1 / (1 - CLOSE), unit=True)


@query(f"""WITH u AS ({STORED_SQL}) SELECT pair_id, string0, string1, round(list_inner_product(a.u, b.u), 6) AS cos, round(least(1, exp(-{ALPHA} * (1 - list_inner_product(a.u, b.u)))), 6) AS score
    FROM pair_links JOIN u a ON a.string = string0 JOIN u b ON b.string = string1""")
def linked_scores(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "pair_links").select("pair_id", "string0", "string1")
    return rounded(vectors.score_pairs(pairs, stored(spark, d), ALPHA), "cos", "score").select("pair_id", "string0", "string1", "cos", "score")


@query(f"""WITH u AS ({STORED_SQL}), t AS (SELECT DISTINCT string FROM link_sets) SELECT string, arg_min(target, {{'a': -round(cos, 12), 'b': target}}) AS target, round(max(cos), 6) AS cos FROM
    (SELECT a.string, b.string AS target, list_inner_product(a.u, b.u) AS cos FROM u a ANTI JOIN t USING (string) JOIN (SELECT * FROM u SEMI JOIN t USING (string)) b ON true) GROUP BY string""")
def stored_nearest_target(spark: SparkSession, d: str) -> DataFrame:
    u, targets = stored(spark, d), listed(spark, d).select("string").distinct()
    return rounded(vectors.nearest_target(u.join(targets, "string", "left_anti"), u.join(targets, "string", "left_semi")), "cos")


ALWAYS_SETS = "SELECT DISTINCT set_id AS key, string FROM link_sets WHERE lower(kind) = 'always'"


@query(f"""WITH m AS ({united(base(), ALWAYS_SETS)}), v AS (SELECT DISTINCT set_id, string, "group" AS label FROM link_sets JOIN m USING (string) WHERE lower(kind) = 'never'),
    bad AS (SELECT set_id FROM v GROUP BY set_id HAVING count(DISTINCT label) < count(*)) SELECT string, set_id AS never_match_group, label AS always_match_group FROM v JOIN bad USING (set_id)""")
def link_set_conflicts(spark: SparkSession, d: str) -> DataFrame:
    m = groups.unite_sets(matches(spark, d), listed(spark, d, "always"))
    return clustering.label_conflicts(m.select("string", F.col("group").alias("label")), listed(spark, d, "never"))


@query(f"""WITH u AS ({U}), g AS ({GOLD}), x AS (SELECT string, n FROM u JOIN g USING (string)) SELECT string, n AS "count", round(sqrt(n), 6) AS w FROM x""")
def embedded(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clustering.SimilarityModel(units(spark, d)).embed(gold(spark, d)).select("string", "count", "w"), "w")


@query(labels(f"""SELECT string, "count" AS n, coalesce(root, "group") AS g FROM ({GOLD}) LEFT JOIN {reach(f'SELECT x."group" AS a, y."group" AS b FROM (SELECT f."group" AS k, min(m."group") AS h FROM {FAST} f JOIN ({GOLD}) m ON m.string = f.string GROUP BY 1) JOIN {FAST} f ON f."group" = k JOIN ({GOLD}) x ON x.string = f.string JOIN ({GOLD}) y ON y."group" = h')} ON a = "group" """, "g"))
def unite_model(spark: SparkSession, d: str) -> DataFrame:
    return groups.unite(gold(spark, d), clustering.SimilarityModel(units(spark, d), ALPHA), threshold=THRESHOLD)


@query("SELECT string, list_transform(u, lambda x: round(x, 6)) AS v FROM (" + U + ")")
def saved_vectors(spark: SparkSession, d: str) -> DataFrame:
    path = f"{Scratch(spark).root}/model"
    clustering.SimilarityModel(units(spark, d), ALPHA).save(path)
    return clustering.SimilarityModel.load(spark, path).vectors.select("string", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query(f"SELECT string FROM ({U}) ORDER BY string LIMIT 20 OFFSET 10")
def sliced_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors.first_rows(units(spark, d), 10, 30).select("string")


@query("SELECT p_partkey, 'name: ' || p_name || '</s>' || upper(p_name) AS t FROM part")
def augmented_strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", augmented("p_name", "name: ").alias("t"))


@query(united(base(), f'SELECT left(string, 6) AS key, string FROM ({base()})'))
def unite_python_key(spark: SparkSession, d: str) -> DataFrame:
    return groups.unite_python(matches(spark, d), lambda s: s[:6])


TOUCHED = f'SELECT string FROM link_sets WHERE set_id = 1'


@query(f"""WITH j AS ({united(base(), f'SELECT "group" AS key, string FROM ({base("max")})')}) SELECT string, "group" FROM j WHERE "group" IN (SELECT "group" FROM j JOIN ({TOUCHED}) USING (string))""")
def touching_groups(spark: SparkSession, d: str) -> DataFrame:
    both = groups.touching(matches(spark, d), matches(spark, d, F.max), listed(spark, d).where("set_id = 1").select("string"))
    return both.select("string", "group")


@query(f'WITH m AS ({base()}) SELECT p.pair_id, p.string0, l.set_id, l.string FROM pair_links p JOIN m x ON x.string = string0 JOIN m y ON y."group" = x."group" JOIN link_sets l ON l.string = y.string')
def merge_links(spark: SparkSession, d: str) -> DataFrame:
    left, right = table(spark, d, "pair_links").select("pair_id", "string0"), listed(spark, d).select("set_id", "string")
    return linkage.merge_tables(left, right, matches(spark, d), "inner", left_on="string0", right_on="string", match_nulls=False).select("pair_id", "string0", "set_id", "string")


@query(f"""WITH m AS ({base()}), l AS (SELECT pair_id, string0, "group" AS g FROM pair_links LEFT JOIN m ON string = string0), r AS (SELECT set_id, s.string, "group" AS g FROM link_sets s LEFT JOIN m ON m.string = s.string)
    SELECT pair_id, string0, l.g AS match_group, set_id, string FROM l FULL JOIN r ON l.g = r.g""")
def merge_links_outer(spark: SparkSession, d: str) -> DataFrame:
    left, right = table(spark, d, "pair_links").select("pair_id", "string0"), listed(spark, d).select("set_id", "string")
    return linkage.merge_tables(left, right, matches(spark, d), "outer", left_on="string0", right_on="string", match_nulls=False).select("pair_id", "string0", "match_group", "set_id", "string")


@query(f"{TOP}, gone AS (SELECT DISTINCT least(x.\"group\", y.\"group\") AS a, greatest(x.\"group\", y.\"group\") AS b FROM scored JOIN g x ON x.string = string0 JOIN g y ON y.string = string1 WHERE score >= 0.3) SELECT string0, string1, group0, group1, round(score, 6) AS score, round(loss, 6) AS loss, impact FROM i ANTI JOIN gone s ON s.a = least(group0, group1) AND s.b = greatest(group0, group1) QUALIFY row_number() OVER (PARTITION BY least(group0, group1), greatest(group0, group1) ORDER BY {BY_IMPACT}) = 1")
def top_pairs_skip_groups(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    skip = s.where("score >= 0.3").select(F.col("string1").alias("string0"), F.col("string0").alias("string1"))
    return rounded(review.top_scored_pairs(s, gold(spark, d), 100_000, skip=skip), "score", "loss")


# --- evaluation ---------------------------------------------------------------------------------------------------------


def _predicted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = matches(spark, d)
    return groups.group_by_key(g, simplify_corp), g


PREDICTED = labels(f'SELECT string, "count" AS n, {corp("string")} AS g FROM ({base()})', "g")


COUNTS = ("TP", "FP", "FN", "TN")


def _text(df: DataFrame, to: str = "string") -> DataFrame:
    """Whole numbers of 38 digits as text (or as numbers where they fit)."""
    return df.withColumns({c: F.col(c).cast(to) for c in COUNTS})


def _confusion(c: str) -> str:
    rows = f'SELECT p.string, CAST({c} AS HUGEINT) AS c, p."group" AS gp, g."group" AS gg FROM ({PREDICTED}) p JOIN ({base()}) g USING (string)'
    return f"""SELECT string, CAST(c AS BIGINT) AS "count", gp AS group_pred, gg AS group_gold, CAST((pg - c) * c AS HUGEINT) AS TP, CAST((np - pg) * c AS HUGEINT) AS FP, CAST((ng - pg) * c AS HUGEINT) AS FN, CAST((n - np - ng + pg) * c AS HUGEINT) AS TN FROM
        (SELECT *, sum(c) OVER (PARTITION BY gp, gg) AS pg, sum(c) OVER (PARTITION BY gp) AS np, sum(c) OVER (PARTITION BY gg) AS ng, sum(c) OVER () AS n FROM ({rows}))"""


def _matrix(c: str) -> str:
    return f"SELECT sum(TP) // 2 AS TP, sum(FP) // 2 AS FP, sum(FN) // 2 AS FN, sum(TN) // 2 AS TN FROM ({_confusion(c)})"


def _as_text(sql: str, more: str = "") -> str:
    return f"SELECT {more}{', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in COUNTS)} FROM ({sql})"


@query(_as_text(_confusion('p."count"'), 'string, "count", group_pred, group_gold, '))
def confusion_rows(spark: SparkSession, d: str) -> DataFrame:
    return _text(evaluate.confusion_rows(*_predicted(spark, d)))


@query(_as_text(_matrix('p."count"')))
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _text(evaluate.confusion_matrix(*_predicted(spark, d)))


@query(_as_text(_matrix("1")))
def confusion_matrix_unweighted(spark: SparkSession, d: str) -> DataFrame:
    return _text(evaluate.confusion_matrix(*_predicted(spark, d), use_counts=False))


def _scores(m: str, predicted: str) -> str:
    return f"""SELECT TP, FP, TN, FN, round((TP + FP + FN + TN) / pairs, 6) AS coverage, round((TP + TN) / (TP + FP + FN + TN), 6) AS accuracy, round(TP / (TP + FP), 6) AS "precision", round(TP / (TP + FN), 6) AS recall, round(2 * TP / (2 * TP + FP + FN), 6) AS F1
        FROM ({m}), (SELECT (sum(CAST("count" AS HUGEINT)) * sum(CAST("count" AS HUGEINT)) - sum(CAST("count" AS HUGEINT) * "count")) / 2 AS pairs FROM ({predicted}))"""


@query(_as_text(_scores(_matrix('p."count"'), PREDICTED), 'coverage, accuracy, "precision", recall, F1, '))
def score_predicted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_text(evaluate.score_predicted(*_predicted(spark, d))), "coverage", "accuracy", "precision", "recall", "F1")


@query(f"""WITH m AS ({base()}), o AS (SELECT "group", row_number() OVER (ORDER BY md5('{SEED}:' || "group"), "group") AS r, count(*) OVER () AS n FROM (SELECT DISTINCT "group" FROM m))
    SELECT string, "count", "group", CASE WHEN r <= floor(0.7 * n) THEN 1 ELSE 2 END AS part FROM m JOIN o USING ("group")""")
def split_on_groups(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.split_on_groups(matches(spark, d), 0.7, SEED)


@query(f"""WITH m AS ({base()}), o AS (SELECT "group", row_number() OVER (ORDER BY "group") - 1 AS r FROM (SELECT DISTINCT "group" FROM m))
    SELECT string, "count", "group", CAST(r % 4 AS INTEGER) AS fold FROM m JOIN o USING ("group")""")
def kfold_sorted(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.kfold_on_groups(matches(spark, d), 4)


STEPS = (0.2725, 0.28, 0.3)


def _sweep_sql() -> str:
    rows = []
    for t in STEPS:
        c = score_to_cos(t, ALPHA)
        p = f"(WITH u AS ({U}) {labels(f'SELECT string, n, coalesce(root, string) AS g FROM u LEFT JOIN {reach(f"SELECT string0 AS a, string1 AS b FROM ({PAIRS.replace(repr(COS), repr(c))})")} ON a = string', 'g')})"
        conf = f'SELECT CAST(p."count" AS HUGEINT) AS c, p."group" AS gp, g."group" AS gg FROM {p} p JOIN ({GOLD}) g USING (string)'
        cells = f"SELECT sum(c) AS s, sum(c * c) AS q, gp, gg FROM ({conf}) GROUP BY gp, gg"
        m = f"""SELECT CAST((pg - q) / 2 AS BIGINT) AS TP, CAST((pp - pg) / 2 AS BIGINT) AS FP, CAST((gq - pg) / 2 AS BIGINT) AS FN, CAST((n * n - pp - gq + pg) / 2 AS BIGINT) AS TN FROM
            (SELECT sum(s * s) AS pg, sum(q) AS q, sum(s) AS n FROM ({cells})), (SELECT sum(s * s) AS pp FROM (SELECT sum(s) AS s FROM ({cells}) GROUP BY gp)), (SELECT sum(s * s) AS gq FROM (SELECT sum(s) AS s FROM ({cells}) GROUP BY gg))"""
        rows.append(f"SELECT *, {t!r}::DOUBLE AS threshold FROM ({_scores(m, GOLD)})")
    return " UNION ALL ".join(rows)


@query(_sweep_sql())
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_text(evaluate.threshold_sweep(units(spark, d), gold(spark, d), STEPS, ALPHA), "long"), "coverage", "accuracy", "precision", "recall", "F1")


@query(f"SELECT arg_min(threshold, {{'a': -F1, 'b': threshold}}) AS threshold, max(F1) AS F1 FROM ({_sweep_sql()})")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_threshold(threshold_sweep(spark, d))


# --- summaries of runs --------------------------------------------------------------------------------------------------


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.8), 6) AS quantile, max(value) AS greatest, round(stddev_samp(value), 6) AS deviation, count(value) AS runs FROM events GROUP BY event_type")
def threshold_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.threshold_summary(table(spark, d, "events"), "event_type", "value"), "mean", "quantile", "deviation")


@query("SELECT event_id, round(CASE WHEN count(*) OVER w = 100 THEN avg(value) OVER w END, 6) AS rolling_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.rolling_mean(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "rolling_mean"), "rolling_mean")


@query("SELECT event_type, round(avg(value), 6) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5 GROUP BY event_type")
def topk_per_group_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.topk_mean(table(spark, d, "events"), "event_type", "value", "event_id"), "top_mean")


@query("SELECT event_id, event_type, value FROM (SELECT *, quantile_cont(value, 0.75) OVER (PARTITION BY event_type) AS q FROM events) WHERE value >= q")
def above_quantile(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.above_quantile(table(spark, d, "events"), "event_type", "value").select("event_id", "event_type", "value")


# --- spelling -----------------------------------------------------------------------------------------------------------

NAMES = "SELECT DISTINCT p_name AS s FROM part WHERE p_name IS NOT NULL"


@query(f"SELECT a.s AS string0, b.s AS string1, CAST(levenshtein(a.s, b.s) AS INTEGER) AS edits FROM ({NAMES}) a JOIN ({NAMES}) b ON a.s < b.s WHERE levenshtein(a.s, b.s) <= 3")
def levenshtein_pairs(spark: SparkSession, d: str) -> DataFrame:
    return spelling.levenshtein_pairs(table(spark, d, "part"), "p_name", 3)


@query(f"""WITH n AS ({NAMES}), g AS (SELECT DISTINCT s, substr(s, i, 3) AS g FROM (SELECT s, unnest(range(1, greatest(length(s) - 2, 1) + 1)) AS i FROM n)),
    w AS (SELECT s, g, ln((SELECT count(*) FROM n) / count(*) OVER (PARTITION BY g)) + 1 AS idf FROM g), u AS (SELECT s, g, idf / sqrt(sum(idf * idf) OVER (PARTITION BY s)) AS w FROM w),
    c AS (SELECT a.s AS string, b.s AS other, sum(a.w * b.w) AS cos FROM u a JOIN u b USING (g) WHERE a.s <> b.s GROUP BY 1, 2)
    SELECT string, arg_min(other, {{'a': -round(cos, 9), 'b': other}}) AS other, round(max(cos), 6) AS cos FROM c GROUP BY string""")
def tfidf_top1(spark: SparkSession, d: str) -> DataFrame:
    return spelling.tfidf_top1(table(spark, d, "part"), "p_name")


@query(f"""WITH n AS (SELECT s, string_split(s, ' ') AS w FROM ({NAMES})) SELECT string0, string1, round(jaccard, 6) AS jaccard FROM (SELECT a.s AS string0, b.s AS string1,
    len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS jaccard FROM n a JOIN n b ON a.s < b.s) WHERE jaccard >= 0.3""")
def token_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spelling.token_jaccard_pairs(table(spark, d, "part"), "p_name", 0.3), "jaccard")


# DuckDB's edit distance and Jaro-Winkler count bytes, and n-grams of all names meet too often there: these have brute-force tests.


@query()
def levenshtein_names(spark: SparkSession, d: str) -> DataFrame:
    return spelling.levenshtein_pairs(table(spark, d, "matcher"), "string", 1)


@query()
def tfidf_names(spark: SparkSession, d: str) -> DataFrame:
    return spelling.tfidf_top1(table(spark, d, "matcher"), "string", 5, 0.8)


@query()
def token_jaccard_names(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spelling.token_jaccard_pairs(table(spark, d, "matcher"), "string", 0.8), "jaccard")


@query()
def jaro_winkler_links(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "pair_links").select("pair_id", spelling.jaro_winkler("string0", "string1").alias("similarity")), "similarity")


@query(f"SELECT a.s AS string0, b.s AS string1, round(jaro_winkler_similarity(a.s, b.s), 6) AS similarity FROM ({NAMES}) a JOIN ({NAMES}) b ON a.s < b.s AND levenshtein(a.s, b.s) <= 3")
def jaro_winkler_pairs(spark: SparkSession, d: str) -> DataFrame:
    near = spelling.levenshtein_pairs(table(spark, d, "part"), "p_name", 3)
    return rounded(near.select("string0", "string1", spelling.jaro_winkler("string0", "string1").alias("similarity")), "similarity")


assert math.isclose(COS, 1 + math.log(THRESHOLD) / ALPHA)

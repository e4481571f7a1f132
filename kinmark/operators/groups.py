"""The group table (string, count, group) and its algebra. Functions take and give DataFrames; nothing is changed in place.

A group table has each string once, in one group, whose label is its member with the greatest count, ties to the first string by
code point. Every function that changes groups or counts sets labels anew. Null strings are no members and are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..plans.skew import join_unique
from ..plans.storage import Scratch
from .components import components

SCHEMA = "string string, count long, `group` string"


def relabel(table: DataFrame, by: str = "group") -> DataFrame:
    """(string, count, group): the rows of table with the canonical label of each set of rows with equal `by`."""
    rows = table.select("string", F.col("count").cast("long").alias("count"), F.col(by).alias("_g"))
    labels = rows.groupBy("_g").agg(F.min_by("string", F.struct(-F.col("count"), F.col("string"))).alias("group"), F.count("*").alias("_n"))
    return join_unique(rows, labels, ["_g"], "_n").select("string", "count", "group")


def from_strings(df: DataFrame, string_column: str = "string", count_column: str | None = None) -> DataFrame:
    """Every string a group of its own; counts are summed, a missing count is 1."""
    n = F.lit(1) if count_column is None else F.coalesce(F.col(count_column), F.lit(1))
    rows = df.where(F.col(string_column).isNotNull()).groupBy(F.col(string_column).alias("string")).agg(F.sum(n).cast("long").alias("count"))
    return rows.withColumn("group", F.col("string"))


def from_groups(df: DataFrame, string_column: str = "string", group_column: str = "group", count_column: str | None = "count") -> DataFrame:
    """Rows with equal group are one group; counts are summed; a string in several groups joins them."""
    rows = df.where(F.col(string_column).isNotNull()).select(F.col(string_column).alias("string"), F.col(group_column).alias("g"), (F.lit(1) if count_column is None else F.coalesce(F.col(count_column), F.lit(1))).alias("n"))
    each = rows.groupBy("string").agg(F.sum("n").cast("long").alias("count"), F.coalesce(F.min("g"), F.first("string")).alias("g"))
    several = rows.groupBy("string").agg(F.min("g").alias("g"), F.max("g").alias("h")).where("g != h").select("string")
    links = rows.join(several, "string").select("string", "g").join(each.select("string", F.col("g").alias("first")), "string").where("g is not null")
    roots = components(links, "g", "first").select(F.col("member").alias("g"), "root")
    return relabel(each.join(roots, "g", "left").select("string", "count", F.coalesce("root", "g").alias("group")))


def from_pairs(df: DataFrame, string0: str = "string0", string1: str = "string1") -> DataFrame:
    """Both strings of a row are one group, transitively; a string's count is its number of appearances."""
    both = df.select(F.explode(F.array(string0, string1)).alias("string")).where("string is not null").groupBy("string").agg(F.count("*").alias("count"))
    roots = components(df, string0, string1).select(F.col("member").alias("string"), F.col("root").alias("group"))
    return relabel(both.join(roots, "string").select("string", "count", "group"))


def from_table(df: DataFrame, match_format: str = "detect", pair_columns: tuple[str, str] = ("string0", "string1"), string_column: str = "string", group_column: str | None = "group", count_column: str = "count") -> DataFrame:
    """A group table from any of the three forms. Detection: unmatched where there is a string column and group_column is None,
    groups where both columns are there, pairs where the columns are just the pair columns; otherwise ValueError."""
    have = set(df.columns)
    if match_format == "detect":
        if string_column in have and group_column is None:
            match_format = "unmatched"
        elif string_column in have and group_column in have:
            match_format = "groups"
        elif have == set(pair_columns):
            match_format = "pairs"
        else:
            raise ValueError(f"no known form in the columns {sorted(have)}")
    count = count_column if count_column in have else None
    if match_format == "unmatched":
        return from_strings(df, string_column, count)
    if match_format == "groups":
        return from_groups(df, string_column, str(group_column), count)
    if match_format == "pairs":
        return from_pairs(df, *pair_columns)
    raise ValueError(f"unknown format {match_format!r}")


def to_table(matches: DataFrame, singletons: bool = True, sort: bool = True) -> DataFrame:
    """The table by falling total of the group, label, falling count, string; on demand without groups of one string."""
    sums = matches.groupBy("group").agg(F.sum("count").alias("_total"), F.count("*").alias("_n"))
    if not singletons:
        sums = sums.where("_n > 1")
    rows = join_unique(matches, sums, ["group"], "_n")
    if sort:
        rows = rows.orderBy(F.desc("_total"), "group", F.desc("count"), "string")
    return rows.select("string", "count", "group")


def group_sizes(matches: DataFrame) -> DataFrame:
    return matches.groupBy("group").agg(F.count("*").alias("strings"), F.sum("count").alias("total"))


def describe(matches: DataFrame, limit: int = 50) -> str:
    """A summary with at most `limit` strings, groups apart."""
    n, groups = matches.agg(F.count("*"), F.countDistinct("group")).first()
    rows = to_table(matches).limit(limit).collect()
    lines, last = [f"{n} strings in {groups} groups"], None
    for r in rows:
        lines += ([""] if last is not None and r["group"] != last else []) + [r["string"]]
        last = r["group"]
    return "\n".join(lines)


def _strings(spark: SparkSession, strings: DataFrame | Iterable[str]) -> DataFrame:
    """One column `string`, each once, from a DataFrame's first column or from Python strings."""
    if isinstance(strings, DataFrame):
        return strings.select(F.col(strings.columns[0]).alias("string")).where("string is not null").distinct()
    if isinstance(strings, str):
        raise ValueError("a list of strings is needed, not one string")
    return spark.createDataFrame([(s,) for s in dict.fromkeys(strings)], "string string")


def _known(matches: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, failing by name when it is run if a string of it is unknown."""
    seen = wanted.join(matches.select("string", F.lit(True).alias("_there")), "string", "left")
    error = F.raise_error(F.concat(F.lit("unknown string: "), F.col("string")))
    return seen.select(F.when(F.col("_there"), F.col("string")).otherwise(error.cast("string")).alias("string"))


def contains(matches: DataFrame, string: str) -> bool:
    return not matches.where(F.col("string") == F.lit(string)).isEmpty()


def lookup(matches: DataFrame, strings: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """strings with the label of each in `label`; an unknown one fails when it is run, or has null where not strict."""
    found = strings.join(matches.select(F.col("string").alias("_s"), F.col("group").alias("label")), F.col(column) == F.col("_s"), "left").drop("_s")
    if not strict:
        return found
    error = F.raise_error(F.concat(F.lit("unknown string: "), F.coalesce(F.col(column), F.lit("null")))).cast("string")
    return found.withColumn("label", F.coalesce("label", error))


def listed(spark: SparkSession, strings: Iterable[str]) -> DataFrame:
    """(place, string) of a list, in its order and with its repetitions."""
    if isinstance(strings, str):
        raise ValueError("a list of strings is needed, not one string")
    return spark.createDataFrame(list(enumerate(strings)), "place long, string string")


def lookup_list(matches: DataFrame, strings: Iterable[str], strict: bool = True) -> DataFrame:
    """(place, string, label) of a list of strings, sorted by place."""
    return lookup(matches, listed(matches.sparkSession, strings), "string", strict).orderBy("place")


def matched_to(matches: DataFrame, strings: DataFrame | Iterable[str]) -> DataFrame:
    """All members of the groups that any of the strings is in."""
    groups = matches.join(_strings(matches.sparkSession, strings), "string", "left_semi").select("group").distinct()
    return matches.join(groups, "group", "left_semi").select("string", "count", "group")


def keep(matches: DataFrame, strings: DataFrame | Iterable[str]) -> DataFrame:
    """The listed strings only; unknown ones are ignored."""
    return relabel(matches.join(_strings(matches.sparkSession, strings), "string", "left_semi"))


def drop(matches: DataFrame, strings: DataFrame | Iterable[str], strict: bool = True) -> DataFrame:
    """Without the listed strings; an unknown one fails when it is run, unless not strict."""
    gone = _strings(matches.sparkSession, strings)
    return relabel(matches.join(_known(matches, gone) if strict else gone, "string", "left_anti"))


def split(matches: DataFrame, strings: DataFrame | Iterable[str], strict: bool = True) -> DataFrame:
    """The listed strings alone; what they leave behind stays together."""
    out = _strings(matches.sparkSession, strings)
    out = (_known(matches, out) if strict else out).withColumn("_alone", F.lit(True))
    rows = matches.join(out, "string", "left").withColumn("_alone", F.coalesce("_alone", F.lit(False)))
    rest = relabel(rows.where(~F.col("_alone")))
    return rest.unionByName(rows.where("_alone").select("string", "count", F.col("string").alias("group")))


def split_all(matches: DataFrame) -> DataFrame:
    return matches.select("string", "count", F.col("string").alias("group"))


def reset_counts(matches: DataFrame) -> DataFrame:
    """All counts 1; labels follow."""
    return relabel(matches.select("string", F.lit(1).cast("long").alias("count"), "group"))


def add_strings(matches: DataFrame, more: DataFrame | Iterable[str], string_column: str = "string", count_column: str | None = None) -> DataFrame:
    """The bag union: counts are added, new strings are groups of their own, labels follow the new counts."""
    new = more if isinstance(more, DataFrame) else matches.sparkSession.createDataFrame([(s,) for s in more], "string string")
    new = from_strings(new, string_column if isinstance(more, DataFrame) else "string", count_column)
    rows = matches.select("string", "count", "group", F.lit(0).alias("_new")).unionByName(new.withColumn("_new", F.lit(1)))
    return relabel(rows.groupBy("string").agg(F.sum("count").alias("count"), F.min_by("group", "_new").alias("group")))


def unite_links(matches: DataFrame, links: DataFrame) -> DataFrame:
    """Groups that share a key of links (key, string) become one, transitively; unknown strings and null keys are ignored."""
    touched = links.select(F.col("key").cast("string").alias("key"), "string").where("key is not null").join(matches.select("string", "group"), "string").select("key", "group").distinct()
    touched = Scratch(matches.sparkSession).write(touched)
    first = touched.groupBy("key").agg(F.min("group").alias("first"), F.count("*").alias("n")).where("n > 1")
    edges = touched.join(first, "key").select("group", "first")
    roots = components(edges, "group", "first").select(F.col("member").alias("group"), "root")
    rows = matches.join(roots, "group", "left").select("string", "count", F.coalesce("root", "group").alias("group"))
    return relabel(rows)


def unite_strings(matches: DataFrame, strings: DataFrame | Iterable[str]) -> DataFrame:
    """The groups of all listed strings become one."""
    return unite_links(matches, _strings(matches.sparkSession, strings).select(F.lit("all").alias("key"), "string"))


def unite_sets(matches: DataFrame, sets: DataFrame | Iterable[Iterable[str]], set_column: str = "set_id") -> DataFrame:
    """Each set's groups become one, transitively."""
    if not isinstance(sets, DataFrame):
        rows = []
        for i, one in enumerate(sets):
            if isinstance(one, str):
                raise ValueError("sets of strings are needed, not strings")
            rows += [(i, s) for s in one]
        sets = matches.sparkSession.createDataFrame(rows, f"{set_column} long, string string")
    return unite_links(matches, sets.select(F.col(set_column).alias("key"), "string"))


def unite_mapping(matches: DataFrame, mapping: DataFrame | dict[str, str]) -> DataFrame:
    """Strings mapped to one label are united; mapping is a table (string, label) or a dict."""
    if isinstance(mapping, dict):
        mapping = matches.sparkSession.createDataFrame(list(mapping.items()), "string string, label string")
    return unite_links(matches, mapping.select(F.col("label").alias("key"), "string"))


def unite_key(matches: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """Strings with equal key are united; key makes a Column of a Column."""
    return unite_links(matches, matches.select(key(F.col("string")).alias("key"), "string"))


def unite_python(matches: DataFrame, key: Callable[[str], str]) -> DataFrame:
    """unite_key by a plain Python function, run in Arrow batches."""
    import pyarrow as pa

    run = F.arrow_udf(lambda c: pa.array([None if s is None else key(s) for s in c.to_pylist()], pa.string()), T.StringType())
    return unite_links(matches, matches.select(run("string").alias("key"), "string"))


def group_by_key(strings: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """unite_key on a table of single strings: one aggregation, no components."""
    return relabel(strings.select("string", "count", key(F.col("string")).alias("_k")), "_k")


def unite_partition(matches: DataFrame, other: DataFrame) -> DataFrame:
    """The join of two partitions over the strings of matches."""
    return unite_links(matches, other.select(F.col("group").alias("key"), "string"))


def add_partitions(a: DataFrame, b: DataFrame) -> DataFrame:
    """All strings of both, counts added, groups joined."""
    return unite_partition(add_strings(a, b, "string", "count"), b)


def unite(matches: DataFrame, target, **options) -> DataFrame:
    """Any of the above by what target is: a partition or mapping table, a dict, a Column function, a model with
    unite_similar, a list of strings or of sets. A single string or anything else is a ValueError."""
    if isinstance(target, str):
        raise ValueError("a single string can't be united")
    if isinstance(target, DataFrame):
        return unite_partition(matches, target) if "group" in target.columns else unite_mapping(matches, target)
    if hasattr(target, "unite_similar"):
        return unite_partition(matches, target.unite_similar(matches, **options))
    if isinstance(target, dict):
        return unite_mapping(matches, target)
    if callable(target):
        return unite_key(matches, target)
    if not isinstance(target, Iterable):
        raise ValueError(f"{type(target).__name__} can't be united")
    items = list(target)
    return unite_strings(matches, items) if all(isinstance(x, str) for x in items) else unite_sets(matches, items)


def touching(matches: DataFrame, other: DataFrame, strings: DataFrame | Iterable[str]) -> DataFrame:
    """Rows (string, count, group) of all groups, joined over both partitions, that touch the given strings."""
    joined = add_partitions(matches, other)
    return matched_to(joined, strings)


def rank_in_group(matches: DataFrame) -> DataFrame:
    """Each string's place in its group by falling count; groups are sorted each by itself."""
    return matches.withColumn("place", F.row_number().over(W.partitionBy("group").orderBy(F.desc("count"), "string")))

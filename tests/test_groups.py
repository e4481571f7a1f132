from __future__ import annotations

import random

import pytest

from kinmark.operators import groups
from kinmark.operators.components import components
from kinmark.operators.linkage import merge_tables


def table(spark, rows):
    return spark.createDataFrame(rows, "string string, count long, `group` string")


def got(df):
    return sorted((r["string"], r["count"], r["group"]) for r in df.select("string", "count", "group").collect())


@pytest.fixture(scope="module")
def base(spark):
    return table(spark, [("a", 3, "a"), ("b", 3, "a"), ("c", 1, "a"), ("d", 5, "d"), ("e", 2, "d"), ("f", 1, "f")])


def test_from_groups_with_nulls_ties_and_repeats(spark):
    raw = spark.createDataFrame([("x", 1, "g"), ("y", 1, "g"), ("y", None, "h"), ("z", 2, "h"), (None, 1, "g"), ("", 1, "k")], "string string, count long, `group` string")
    assert got(groups.from_table(raw)) == [("", 1, ""), ("x", 1, "y"), ("y", 2, "y"), ("z", 2, "y")]


def test_from_pairs_is_transitive(spark):
    raw = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "d"), ("e", None)], "string0 string, string1 string")
    assert got(groups.from_table(raw)) == [("a", 2, "a"), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "d"), ("e", 1, "e")]


def test_detection_fails_by_name(spark):
    with pytest.raises(ValueError):
        groups.from_table(spark.createDataFrame([("a",)], "name string"))
    with pytest.raises(ValueError):
        groups.from_table(spark.createDataFrame([("a",)], "string string"))


def test_keep_drop_split(base):
    assert got(groups.drop(base, ["a"])) == [("b", 3, "b"), ("c", 1, "b"), ("d", 5, "d"), ("e", 2, "d"), ("f", 1, "f")]
    assert got(groups.keep(base, ["c", "b", "unknown"])) == [("b", 3, "b"), ("c", 1, "b")]
    assert got(groups.split(base, ["a", "e"])) == [("a", 3, "a"), ("b", 3, "b"), ("c", 1, "b"), ("d", 5, "d"), ("e", 2, "e"), ("f", 1, "f")]
    with pytest.raises(Exception, match="unknown string"):
        groups.drop(base, ["nobody"]).collect()


def test_unite_forms(base):
    joined = [("a", 3, "d"), ("b", 3, "d"), ("c", 1, "d"), ("d", 5, "d"), ("e", 2, "d"), ("f", 1, "f")]
    assert got(groups.unite(base, ["c", "e", "unknown"])) == joined
    assert got(groups.unite(base, [["c", "e"], ["unknown"]])) == joined
    assert got(groups.unite(base, {"c": "k", "e": "k"})) == joined
    for bad in ("c", 5):
        with pytest.raises(ValueError):
            groups.unite(base, bad)


def test_add_conserves_counts(spark, base):
    more = groups.add_strings(base, ["a", "new", "new"])
    assert sum(n for _, n, _ in got(more)) == 18
    assert ("new", 2, "new") in got(more)


def test_sorted_table(base):
    assert [r["string"] for r in groups.to_table(base).collect()] == ["a", "b", "c", "d", "e", "f"]
    assert groups.to_table(base, singletons=False).count() == 5


def test_components_against_union_find(spark):
    rng = random.Random(4)
    for n, m in ((30, 25), (60, 70)):
        links = [(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(m)]
        parent = {x: x for e in links for x in e}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        found = {r["member"]: r["root"] for r in components(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()}
        assert found.keys() == parent.keys()
        assert {frozenset(x for x in found if found[x] == r) for r in found.values()} == {frozenset(x for x in parent if find(x) == find(y)) for y in parent}


def test_merge_nulls_and_errors(spark, base):
    left = spark.createDataFrame([("a", 1), ("zz", 2)], "name string, v int")
    right = spark.createDataFrame([("b", 3), ("yy", 4)], "name string, v int")
    rows = merge_tables(left, right, base, on="name").collect()
    assert {(r["name_x"], r["v_y"], r["match_group"]) for r in rows} == {("a", 3, "a"), ("zz", 4, None)}
    assert merge_tables(left, right, base, on="name", match_nulls=False).count() == 1
    assert merge_tables(left, right, base, how="outer", on="name", match_nulls=False).count() == 3
    with pytest.raises(ValueError):
        merge_tables(left, right, base)
    with pytest.raises(ValueError):
        merge_tables(left, right, base, on="name", group_column="v")


def test_empty_tables(spark):
    none = table(spark, [])
    for f in (groups.relabel, groups.to_table, groups.split_all, groups.reset_counts):
        assert got(f(none)) == []
    assert got(groups.unite(none, ["a"])) == []

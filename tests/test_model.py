from __future__ import annotations

import logging
import math

import numpy as np
import pytest

from kinmark.functions.scores import first_pool, mean_pool, project
from kinmark.operators import clustering, evaluate, groups, review, spelling, vectors

TABLE = "string string, count long, `group` string"
NAMES = ["blue heron", "blue herons", "red kite", "red kites", "gannet"]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(s, i + 1, s) for i, s in enumerate(NAMES)], TABLE)


def test_a_model_with_an_encoder_is_saved_and_loaded(spark, names, tmp_path):
    model = clustering.SimilarityModel(encoder=clustering.hashed_ngrams, alpha=2.0, prompt="", upper=False)
    found = {r["string"]: r["group"] for r in groups.unite(names, model, threshold=0.5).collect()}
    assert found == {"blue heron": "blue herons", "blue herons": "blue herons", "red kite": "red kites", "red kites": "red kites", "gannet": "gannet"}
    model.save(str(tmp_path / "m"), names)
    back = clustering.SimilarityModel.load(spark, str(tmp_path / "m"))
    assert (back.alpha, back.exponent, back.vectors.count()) == (2.0, 0.5, 5)
    assert {r["string"]: r["group"] for r in groups.unite(names, back, threshold=0.5).collect()} == found
    with pytest.raises(ValueError):
        clustering.SimilarityModel()
    with pytest.raises(ValueError):
        model.save(str(tmp_path / "n"))


def test_encoding_takes_each_string_once(spark):
    df = spark.createDataFrame([("a b",), ("a b",), (None,), ("",)], "string string")
    rows = {r["string"]: r["v"] for r in clustering.encode(df, clustering.hashed_ngrams, batch=1).collect()}
    assert rows.keys() == {"a b", ""} and all(math.isclose(np.linalg.norm(v), 1) for v in rows.values())
    assert clustering.encode(df.where("false"), clustering.hashed_ngrams).count() == 0


def test_pooling_and_projection(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([], [])], "t array<array<double>>, m array<int>")
    rows = df.select(mean_pool(df.t, df.m).alias("mean"), mean_pool(df.t).alias("all"), first_pool(df.t).alias("first"), project(first_pool(df.t), [[1, 0], [1, 1], [0, 2]]).alias("p")).collect()
    assert rows[0]["mean"] == [2, 3] and rows[0]["first"] == [1, 2] and rows[0]["p"] == [1, 3, 4] and np.allclose(rows[0]["all"], [13 / 3, 5])
    assert rows[1]["mean"] is None and rows[1]["first"] is None


def test_lists_keep_their_order(spark, names):
    wanted = ["gannet", "red kite", "gannet"]
    assert [(r["place"], r["label"]) for r in groups.lookup_list(names, wanted).collect()] == [(0, "gannet"), (1, "red kite"), (2, "gannet")]
    assert [r["label"] for r in groups.lookup_list(names, ["x", "gannet"], strict=False).collect()] == [None, "gannet"]
    v = spark.createDataFrame([(s, [1.0, float(i)]) for i, s in enumerate(NAMES)], "string string, v array<double>")
    assert [r["v"][1] for r in vectors.pick(v, wanted).collect()] == [4, 2, 4]
    with pytest.raises(Exception, match="unknown string: x"):
        vectors.pick(v, ["x"]).collect()
    assert [r["string"] for r in vectors.first_rows(v, 1, 3).collect()] == sorted(NAMES)[1:3]


def test_conflicts_are_warned_of(spark, names, caplog):
    sets = spark.createDataFrame([(1, "red kite"), (1, "red kites")], "set_id long, string string")
    v = clustering.encode(names, clustering.hashed_ngrams).join(names.select("string", "count"), "string")
    with caplog.at_level(logging.WARNING):
        clustering.united_pairs(v, 0.5, 2.0, always=sets, never=sets).count()
    assert "red kite" in caplog.text
    with pytest.raises(ValueError, match="conflict"):
        clustering.united_pairs(v, 0.5, 2.0, always=sets, never=sets, conflicts="raise")


def test_skipped_pairs_take_their_groups_along(spark):
    scored = spark.createDataFrame([("a", "c", "A", "C", 0.9, 0.1), ("b", "c", "A", "C", 0.8, 0.1), ("a", "d", "A", "D", 0.7, 0.1)], "string0 string, string1 string, group0 string, group1 string, score double, loss double")
    m = spark.createDataFrame([("a", 1, "A"), ("b", 1, "A"), ("c", 1, "C"), ("d", 1, "D")], TABLE)
    skip = spark.createDataFrame([("c", "a")], "string0 string, string1 string")
    pairs = lambda **k: [(r["string0"], r["string1"]) for r in review.top_scored_pairs(scored, m, skip=skip, **k).collect()]
    assert pairs() == [("a", "d")] and pairs(by_group=False) == [("b", "c"), ("a", "d")]


def test_quantiles_of_bounded_memory(spark):
    df = spark.range(10001).selectExpr("'x' AS g", "CAST(id AS DOUBLE) AS v")
    exact, near = (evaluate.threshold_summary(df, "g", "v", accuracy=a).first()["quantile"] for a in (None, 1000))
    assert exact == 8000 and abs(near - exact) <= 11
    assert abs(evaluate.above_quantile(df, "g", "v", accuracy=1000).count() - 2501) <= 11


def brute_top(strings, n, least):
    grams = {s: {s[i : i + n] for i in range(max(1, len(s) - n + 1))} for s in strings}
    df: dict[str, int] = {}
    for g in grams.values():
        for x in g:
            df[x] = df.get(x, 0) + 1
    idf = {x: math.log(len(strings) / k) + 1 for x, k in df.items()}
    unit = {s: {x: idf[x] / math.sqrt(sum(idf[y] ** 2 for y in g)) for x in g} for s, g in grams.items()}
    out = {}
    for s in strings:
        cos = [(-round(sum(w * unit[o].get(x, 0) for x, w in unit[s].items()), 9), o) for o in strings if o != s]
        best = min(c for c in cos if c[0] < 0) if any(c[0] < 0 for c in cos) else (0, "")
        if -best[0] >= max(least, 1e-9):
            out[s] = (best[1], round(-best[0], 6))
    return out


@pytest.mark.parametrize("least", [0.0, 0.5, 0.8])
def test_tfidf_prefixes_lose_nothing(spark, least):
    rng = np.random.default_rng(3)
    strings = sorted({"".join(rng.choice(list("abc "), 6)) for _ in range(120)})
    df = spark.createDataFrame([(s,) for s in [*strings, *strings[:5], None]], "x string")
    got = {r["string"]: (r["other"], r["cos"]) for r in spelling.tfidf_top1(df, "x", 3, least).collect()}
    assert got == brute_top(strings, 3, least)


def test_jaro_winkler(spark):
    cases = [("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("", "", 0.0), ("", "a", 0.0), ("abc", "xyz", 0.0), ("émile", "emile", 0.866667), ("same", "same", 1.0), (None, "a", None)]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(spelling.jaro_winkler("a", "b").alias("s"))
    assert [r["s"] if r["s"] is None else round(r["s"], 6) for r in df.collect()] == [c[2] for c in cases]


def test_edits_over_all_pairs(spark):
    rng = np.random.default_rng(5)
    strings = sorted({"".join(rng.choice(list("ab"), rng.integers(0, 7))) for _ in range(60)})
    df = spark.createDataFrame([(s,) for s in strings], "x string")
    for k in (1, 2):
        got = {(r["string0"], r["string1"]): r["edits"] for r in spelling.levenshtein_pairs(df, "x", k).collect()}
        every = df.selectExpr("x AS a").crossJoin(df.selectExpr("x AS b")).where("a < b").selectExpr("a", "b", "levenshtein(a, b) AS e").where(f"e <= {k}").collect()
        assert got == {(r["a"], r["b"]): r["e"] for r in every}

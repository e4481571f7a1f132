from __future__ import annotations

import numpy as np
import pytest

from kinmark.functions.scores import score_to_cos
from kinmark.operators import clustering, evaluate, spelling
from kinmark.operators.calibrate import fit_alpha
from kinmark.operators.vectors import similar_pairs, unit_vectors

ALPHA = 2.0


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 6))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def vectors(spark, points):
    rows = [(f"s{i:02d}", p.tolist(), i % 4 + 1) for i, p in enumerate(points)]
    return unit_vectors(spark.createDataFrame(rows, "string string, v array<double>, n long"), "string", "v", "n")


def groups_of(df):
    out: dict[str, set[str]] = {}
    for r in df.collect():
        out.setdefault(r["group"], set()).add(r["string"])
    return {frozenset(x) for x in out.values()}


def greedy(points, t, group_t, never):
    """One by one over the whole list, with no components."""
    n = len(points)
    cos = points @ points.T
    pairs = sorted(((-cos[i, j], i, j) for i in range(n) for j in range(i + 1, n) if cos[i, j] >= t))
    of = list(range(n))
    members = {i: {i} for i in range(n)}
    sets = {i: {k for k, s in enumerate(never) if i in s} for i in range(n)}
    dead = set()
    for _, i, j in pairs:
        a, b = of[i], of[j]
        if a == b or (i, j) in dead:
            continue
        ok = not sets[a] & sets[b]
        if ok and group_t is not None and len(members[a] | members[b]) > 2:
            ok = min(cos[x, y] for x in members[a] for y in members[b]) >= group_t
        if not ok:
            dead |= {(min(x, y), max(x, y)) for x in members[a] for y in members[b]}
            continue
        for x in members[b]:
            of[x] = a
        members[a] |= members.pop(b)
        sets[a] |= sets[b]
    return {frozenset(f"s{x:02d}" for x in m) for m in members.values()}


def test_pairs_are_exact(vectors, points):
    cos = points @ points.T
    want = {(f"s{i:02d}", f"s{j:02d}") for i in range(40) for j in range(i + 1, 40) if cos[i, j] >= 0.5}
    assert {(r["string0"], r["string1"]) for r in similar_pairs(vectors, 0.5).collect()} == want


def test_fast_and_constrained(spark, vectors, points):
    t = score_to_cos(0.45, ALPHA)
    assert groups_of(clustering.unite_similar(vectors, 0.45, ALPHA)) == greedy(points, t, None, [])
    got = clustering.unite_similar(vectors, 0.45, ALPHA, group_threshold=0.5)
    assert groups_of(got) == greedy(points, t, score_to_cos(0.5, ALPHA), [])
    never = [set(range(0, 12)), {3, 20, 30}]
    sets = spark.createDataFrame([(k, f"s{i:02d}") for k, s in enumerate(never) for i in s], "set_id long, string string")
    assert groups_of(clustering.unite_similar(vectors, 0.45, ALPHA, never=sets)) == greedy(points, t, None, never)
    with pytest.raises(ValueError):
        clustering.united_pairs(vectors, 0.5, ALPHA, group_threshold=0.4)


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(f"x{i}", int(rng.integers(1, 4)), f"g{rng.integers(9)}", f"h{rng.integers(7)}") for i in range(60)]
    p = spark.createDataFrame([(s, c, g) for s, c, g, _ in rows], "string string, count long, `group` string")
    g = spark.createDataFrame([(s, 1, h) for s, _, _, h in rows], "string string, count long, `group` string")
    want = {"TP": 0, "FP": 0, "FN": 0, "TN": 0}
    copies = [(a, b) for _, c, a, b in rows for _ in range(c)]
    ids = [i for i, (_, c, _, _) in enumerate(rows) for _ in range(c)]
    for i in range(len(copies)):
        for j in range(i):
            if ids[i] != ids[j]:
                same, gold = copies[i][0] == copies[j][0], copies[i][1] == copies[j][1]
                want["TP" if same and gold else "FP" if same else "FN" if gold else "TN"] += 1
    m = evaluate.confusion_matrix(p, g).first()
    assert {k: int(m[k]) for k in want} == want
    each = evaluate.confusion_rows(p, g).groupBy().sum("TP", "FP", "FN", "TN").first()
    assert [int(x) for x in each] == [2 * want[k] for k in want]
    assert evaluate.score_predicted(p.where("false"), g).first()["F1"] == 0


def test_edit_pairs(spark):
    words = ["", "a", "kitten", "sitten", "sittin", "mitten", "kit", "smitten", "kiten", "kitetn"]
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for k in (1, 2):
        want = {(a, b, lev(a, b)) for a in words for b in words if a < b and lev(a, b) <= k}
        found = spelling.levenshtein_pairs(spark.createDataFrame([(w,) for w in [*words, None, "kit"]], "w string"), "w", k)
        assert {(r[0], r[1], r[2]) for r in found.collect()} == want


def test_alpha(spark):
    pairs = spark.createDataFrame([(0.95, True), (0.9, True), (0.4, False), (0.2, False)], "cos double, same boolean")
    alpha, loss = fit_alpha(pairs)
    assert 1 < alpha < 20 and loss < 0.4


@pytest.mark.parametrize("group_threshold", [None, 0.6])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_decide_as_one_pair_after_the_other(spark, monkeypatch, seed, group_threshold):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(40, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    u = spark.createDataFrame([(f"s{i:02d}", int(i % 3 + 1), x.tolist()) for i, x in enumerate(v)], "string string, count long, v array<double>")
    never = spark.createDataFrame([(int(rng.integers(4)), f"s{int(i):02d}") for i in rng.integers(0, 40, 14)], "set_id long, string string")
    pairs = lambda: sorted((r["i"], r["j"], r["n_i"], r["n_j"], round(r["cos"], 9)) for r in clustering.united_pairs(u, 0.5, 2.0, group_threshold, never=never).collect())
    one_task = pairs()
    monkeypatch.setattr(clustering, "COMPONENT", 3)
    assert pairs() == one_task and len(one_task) > 5

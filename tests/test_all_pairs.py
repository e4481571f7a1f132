from __future__ import annotations

import numpy as np
import pytest

from kinmark.operators import vectors

ALPHA = 2.0


def loss_of(cos, same, alpha=ALPHA):
    z = max(alpha * (1 - cos), 1e-6)
    return z if same else -np.log(-np.expm1(-z))


@pytest.fixture(scope="module")
def case(spark):
    """30 strings over several small blocks; members of a group point anywhere, so the hardest positives have low cosines."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(30, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s, g = [f"s{i:02d}" for i in range(30)], [f"g{i % 4}" if i % 9 else "g0" for i in range(30)]
    u = spark.createDataFrame([(x, 1, y.tolist()) for x, y in zip(s, v, strict=True)], "string string, count long, v array<double>")
    m = spark.createDataFrame([(x, 1, y) for x, y in zip(s, g, strict=True)], "string string, count long, `group` string")
    cos = v @ v.T
    pairs = [(s[i], s[j], g[i], g[j], cos[i, j], loss_of(cos[i, j], g[i] == g[j])) for i in range(30) for j in range(i + 1, 30)]
    return u, m, pairs


@pytest.fixture(params=[2048, 7])
def block(request, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", request.param)


def test_hardest_partner_is_of_all_pairs(case, block):
    u, m, pairs = case
    ends = [(a, b, x) for a, b, *_, x in pairs] + [(b, a, x) for a, b, *_, x in pairs]
    want = {s: min((-round(x, 9), o) for a, o, x in ends if a == s)[1] for s in {a for a, _, _ in ends}}
    got = {r["string"]: r["other"] for r in vectors.hardest_of_all(u, m, ALPHA).collect()}
    assert got == want
    cut = {r["string"]: r["other"] for r in vectors.hardest_pairs(vectors.scored_pairs(u, m, ALPHA, min_score=0.2725)).collect()}
    assert cut != want


def test_mean_losses_are_of_all_pairs(case, block):
    u, m, pairs = case
    got = {r["alpha"]: r["loss"] for r in vectors.mean_losses_of_all(u, m, [0.5, 2.0]).collect()}
    assert got == pytest.approx({a: np.mean([loss_of(c, x == y, a) for _, _, x, y, c, _ in pairs]) for a in (0.5, 2.0)})


@pytest.mark.parametrize("by_group", [True, False])
@pytest.mark.parametrize("skipped", [False, True])
def test_top_pairs_are_of_all_pairs(spark, case, block, by_group, skipped):
    u, m, pairs = case
    of = {r["string"]: r["group"] for r in m.collect()}
    size = {g: list(of.values()).count(g) for g in of.values()}
    rows = sorted((-size[x] * size[y], -round(np.exp(-ALPHA * (1 - c)), 9), a, b) for a, b, x, y, c, _ in pairs if x != y)
    out = [rows[0][2:], rows[1][2:]] if skipped else []
    if by_group:
        gone = {frozenset((of[a], of[b])) for a, b in out}
        kept = {}
        for r in rows:
            kept.setdefault(frozenset((of[r[2]], of[r[3]])), r)
        rows = sorted(r for k, r in kept.items() if k not in gone)
    else:
        rows = [r for r in rows if r[2:] not in out]
    skip = spark.createDataFrame([(b, a) for a, b in out], "string0 string, string1 string") if skipped else None
    got = [(r["string0"], r["string1"]) for r in vectors.top_of_all(u, m, ALPHA, 5, by_group, skip=skip).collect()]
    assert got == [r[2:] for r in rows[:5]]

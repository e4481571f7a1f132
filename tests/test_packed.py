from __future__ import annotations

import numpy as np
import pytest

from kinmark.operators import clustering, vectors


@pytest.fixture
def clustered(spark, monkeypatch):
    """Small blocks; 300 vectors near 30 centres, of any length, and what all pairs give."""
    monkeypatch.setattr(vectors, "ROWS", 48)
    monkeypatch.setattr(vectors, "SLICE", 20)
    monkeypatch.setattr(vectors, "STEP", 7)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16))
    v = ((centres[rng.integers(0, 30, 300)] + rng.standard_normal((300, 16)) * 0.25) * rng.uniform(0.1, 9, (300, 1))).astype(np.float32)
    v[299] = v[0]
    names = [f"s{i:03d}" for i in rng.permutation(300)]
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    df = spark.createDataFrame([(s, 1, x) for s, x in zip(names, v.tolist(), strict=True)], "string string, count long, v array<float>")
    return df, names, u @ u.T


@pytest.mark.parametrize("min_cos", [0.9, 0.7, 0.2, -0.5, -99.0])
def test_packed_blocks_give_every_pair_once(clustered, min_cos):
    df, names, cos = clustered
    want = {(min(names[i], names[j]), max(names[i], names[j])): cos[i, j] for i in range(300) for j in range(i) if cos[i, j] >= min_cos}
    rows = vectors.similar_pairs(df, min_cos, unit=True).collect()
    assert len(rows) == len(want) and all(abs(want[r["string0"], r["string1"]] - r["cos"]) < 1e-9 for r in rows)


def test_no_vector_is_shuffled_once_for_each_block(clustered):
    plan = vectors.similar_pairs(clustered[0], 0.9, unit=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


@pytest.mark.parametrize("min_cos", [0.9, 0.8, 0.5])
def test_groups_come_from_fewer_pairs(clustered, min_cos):
    df, names, cos = clustered
    root = {s: s for s in names}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    pairs = [(names[i], names[j]) for i in range(300) for j in range(i) if cos[i, j] >= min_cos]
    for a, b in pairs:
        root[find(a)] = find(b)
    want = {frozenset(s for s in names if find(s) == r) for r in names if find(r) == r}
    got: dict[str, set] = {}
    for r in clustering.unite_similar(df, float(np.exp(-50 * (1 - min_cos))), 50.0, unit=True).collect():
        got.setdefault(r["group"], set()).add(r["string"])
    assert {frozenset(x) for x in got.values()} == want
    joining = vectors.joining_pairs(df, min_cos, unit=True).collect()
    assert all(find(r["string0"]) == find(r["string1"]) for r in joining) and len(joining) < len(pairs)


def test_no_vectors_give_no_pairs(spark):
    assert vectors.similar_pairs(spark.createDataFrame([], "string string, v array<double>"), 0.5).count() == 0

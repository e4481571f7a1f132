from __future__ import annotations

import random
from collections import Counter
from itertools import product

import pytest

from kinmark.llm import splits


def off(units, shares):
    """The sum of squared distances of the plan's totals, and the least one by brute force."""
    total, whole = sum(units), sum(x for _, x in shares)
    targets = [total * x / whole for _, x in shares]
    plan = splits.plan_splits(dict(Counter(units)), shares)
    assert sorted(s for s, _, a, b in plan for _ in range(b - a)) == sorted(units)
    got = [sum(s * (b - a) for s, name, a, b in plan if name == x) for x, _ in shares]
    square = lambda t: sum((a - b) ** 2 for a, b in zip(t, targets, strict=True))
    ways = product(range(len(shares)), repeat=len(units))
    best = min(square([sum(u for u, i in zip(units, w, strict=True) if i == k) for k in range(len(shares))]) for w in ways)
    return square(got), best


def test_few_large_units_in_halves():
    assert off([3, 3, 2, 2, 2], [("a", 0.5), ("b", 0.5)]) == (0, 0)


@pytest.mark.parametrize("shares", [[("a", 0.5), ("b", 0.5)], [("a", 0.8), ("b", 0.2)], [("a", 0.7), ("b", 0.2), ("c", 0.1)]])
@pytest.mark.parametrize("largest", [9, 500, 100_000])
def test_few_large_units_against_brute_force(shares, largest):
    rng = random.Random(largest)
    for _ in range(8):
        units = [rng.randint(1, largest) for _ in range(rng.randint(2, 8))]
        got, best = off(units, shares)
        assert got == pytest.approx(best, abs=1e-6), units

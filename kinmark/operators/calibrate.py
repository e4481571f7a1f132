"""Fitting alpha, the one parameter of the score, to labelled pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import pair_loss


def alpha_losses(pairs: DataFrame, alphas: list[float]) -> DataFrame:
    """(alpha, loss): mean loss of pairs (cos, same) at each alpha, all in one pass."""
    sums = pairs.agg(*(F.avg(pair_loss(F.col("cos"), F.col("same"), a)).alias(f"_{i}") for i, a in enumerate(alphas)))
    each = F.array(*(F.struct(F.lit(float(a)).alias("alpha"), F.col(f"_{i}").alias("loss")) for i, a in enumerate(alphas)))
    return sums.select(F.explode(each).alias("e")).select("e.alpha", "e.loss")


def fit_alpha(pairs: DataFrame, low: float = 0.1, high: float = 500.0, rounds: int = 4, points: int = 16) -> tuple[float, float]:
    """(alpha, loss) of least mean loss, by a grid that is drawn closer around the best point; one aggregate a round."""
    best = (low, math.inf)
    for _ in range(rounds):
        grid = [low * (high / low) ** (i / (points - 1)) for i in range(points)]
        rows = [(r["alpha"], r["loss"]) for r in alpha_losses(pairs, grid).collect() if r["loss"] is not None]
        if not rows:
            return best
        best = min([*rows, best], key=lambda x: (x[1], x[0]))
        at = min(range(points), key=lambda i: abs(grid[i] - best[0]))
        low, high = grid[max(at - 1, 0)], grid[min(at + 1, points - 1)]
    return best

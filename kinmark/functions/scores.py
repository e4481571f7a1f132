"""Similarity scores, losses and weights of vectors and pairs, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ALWAYS = -99.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """v at length one; null where its length is zero or any number is missing."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def score(cos: Column, alpha: float) -> Column:
    """exp(-alpha (1 - cos)), at most 1."""
    return F.least(F.lit(1.0), F.exp(F.lit(-float(alpha)) * (1 - cos)))


def score_to_cos(threshold: float, alpha: float) -> float:
    """The cosine at which the score is threshold, so that pairs are filtered before any exponential is taken."""
    return 1 + math.log(threshold) / alpha if threshold > 0 else ALWAYS


def pair_loss(cos: Column, same: Column, alpha: float, weight0: Column | None = None, weight1: Column | None = None, square_weighted: bool = True) -> Column:
    """Cross entropy of a pair's score against whether it is a match; with weights w0 w1 L^2, or w0 w1 L where not squared."""
    z = F.greatest(F.lit(float(alpha)) * (1 - cos), F.lit(1e-6))
    loss = F.when(same, z).otherwise(-F.log(-F.expm1(-z)))
    if weight0 is None or weight1 is None:
        return loss
    return weight0 * weight1 * (loss * loss if square_weighted else loss)


def weight(count: Column, exponent: float = 0.5) -> Column:
    return F.pow(count.cast("double"), F.lit(float(exponent)))


def mean_pool(tokens: Column, mask: Column | None = None) -> Column:
    """The mean of token vectors (array of arrays), of those with a true mask where there is one; null where there are none."""
    kept = tokens if mask is None else F.transform(F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda x: x["m"].cast("boolean")), lambda x: x["v"])
    total = F.aggregate(F.slice(kept, 2, F.size(kept)), kept[0], lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def first_pool(tokens: Column) -> Column:
    """The first token's vector."""
    return F.get(tokens, F.lit(0))


def project(v: Column, matrix: list[list[float]]) -> Column:
    """v times a matrix, which is given by its columns: one number of the result for each."""
    return F.array(*(dot(v, F.array(*(F.lit(float(x)) for x in column))) for column in matrix))

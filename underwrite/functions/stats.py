"""Closed-form statistics on already aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from underwrite.config import Z_95
from underwrite.functions.parsing import col, dec


def two_sided_p(z: Column | str) -> Column:
    """Two-sided normal tail of a z column, NULL-safe.

    Spark has no error function; callers pass aggregates, so the batch UDF sees a few rows. It is
    defined here to travel to the workers by value.
    """

    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore").astype("float64")

    value = col(z)
    return F.when(value.isNotNull(), F.pandas_udf(tail, T.DoubleType())(value))


def wilson(successes: Column | str, n: Column | str, z: float = Z_95) -> tuple[Column, Column]:
    """Lower and upper Wilson limit of a proportion; NULL without observations."""
    k, size = col(successes).cast("double"), col(n).cast("double")
    p = F.try_divide(k, size)
    z2 = dec(z * z)
    scale = dec(1) + F.try_divide(z2, size)
    center = (p + F.try_divide(z2, size * 2)) / scale
    half = dec(z) * F.sqrt(p * (dec(1) - p) / size + z2 / (size * size * 4)) / scale
    return F.when(size > 0, center - half), F.when(size > 0, center + half)


def two_proportion_z(x1: Column | str, n1: Column | str, x2: Column | str, n2: Column | str) -> Column:
    """Pooled z of two proportions: NULL when a side is empty, 0 when there is no spread."""
    a, m, b, n = (col(c).cast("double") for c in (x1, n1, x2, n2))
    pooled = F.try_divide(a + b, m + n)
    se = F.sqrt(pooled * (dec(1) - pooled) * (F.try_divide(dec(1), m) + F.try_divide(dec(1), n)))
    z = F.try_divide(F.try_divide(a, m) - F.try_divide(b, n), se)
    return F.when(F.least(m, n) > 0, F.when(se == 0, dec(0)).otherwise(z))


#: Both samples of at most this many values have the exact law of the distance.
KS_EXACT_ROWS = 10_000


def ks_p_value(distance: Column | str, n1: Column | str, n2: Column | str, terms: int = 100, exact_rows: int = KS_EXACT_ROWS) -> Column:
    """Two-sample Kolmogorov tail from the distance and both sample sizes: the exact law while no sample has more
    than ``exact_rows`` values, the asymptotic one above. Callers pass one row per feature; NULL stays NULL.

    Every order of the n + m values is equally likely, so the values arrive one by one and belong to the first
    sample with chance (left of it) / (left of both). ``inside`` holds the chances of having seen x values of the
    first sample without having reached the distance; what reaches it at a step is added up, so small tails keep
    their digits.
    """

    def tail(apart: float, n: int, m: int) -> float:
        size, limit = n + m, round(apart * n * m)
        inside, low, high, reached = np.zeros(n + 2), 0, 0, 0.0
        inside[0] = 1.0
        for t in range(size):
            x = np.arange(low, high + 1)
            first = inside[low : high + 1] * (n - x) / (size - t)
            inside[low : high + 1] *= (m - t + x) / (size - t)
            inside[low + 1 : high + 2] += first
            # x stays while |x / n - y / m| < distance, with y = t + 1 - x
            least = max(low, ((t + 1) * n - limit) // size + 1)
            most = min(high + 1, n, -((-(t + 1) * n - limit) // size) - 1)
            if least > most:
                return 1.0
            reached += inside[low:least].sum() + inside[most + 1 : high + 2].sum()
            inside[low:least] = 0.0
            inside[most + 1 : high + 2] = 0.0
            low, high = least, most
        return min(float(reached), 1.0)

    def exact(distances: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        rows = zip(distances, left, right, strict=True)
        known = [tail(d, int(min(a, b)), int(max(a, b))) if d == d and 0 < min(a, b) and max(a, b) <= exact_rows else None for d, a, b in rows]
        return pd.Series(known, dtype="float64")

    d, m, n = (col(c).cast("double") for c in (distance, n1, n2))
    small = F.pandas_udf(exact, T.DoubleType())(d, m, n)
    return F.when(F.greatest(m, n) <= exact_rows, small).otherwise(asymptotic_ks_tail(d, m, n, terms))


def asymptotic_ks_tail(distance: Column | str, n1: Column | str, n2: Column | str, terms: int = 100) -> Column:
    """Limit of the tail for large samples."""
    d, m, n = (col(c).cast("double") for c in (distance, n1, n2))
    scaled = d * F.sqrt(F.try_divide(m * n, m + n))

    def add(total: Column, k: Column) -> Column:
        sign = F.when(k % 2 == 1, dec(1)).otherwise(dec(-1))
        return total + sign * F.exp(dec(-2) * k * k * scaled * scaled)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), dec(0), add)
    # Below 0.2 the alternating series has not converged and the tail is 1 to twelve digits.
    tail = F.when(scaled < 0.2, dec(1)).otherwise(F.greatest(dec(0), F.least(dec(1), series * 2)))
    return F.when(scaled.isNotNull(), tail)


def interpret_difference(delta: Column, p_adjusted: Column, margin: float, alpha: float) -> Column:
    """Joint reading of statistical and practical significance of ``A - B``."""
    significant = F.coalesce(p_adjusted < alpha, F.lit(False))
    material = F.abs(delta) >= margin
    winner = F.when(delta > 0, "A").otherwise("B")
    return (
        F.when(
            significant & material,
            F.concat(F.lit("Diferencia significativa y material a favor de "), winner),
        )
        .when(significant, "Estadísticamente significativa pero prácticamente irrelevante")
        .when(material, "Diferencia de tamaño relevante pero no concluyente (incertidumbre alta)")
        .otherwise("Sin evidencia de diferencia: modelos prácticamente equivalentes")
    )

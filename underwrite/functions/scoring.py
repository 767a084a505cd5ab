"""Numeric columns used by features, scores and metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from underwrite.config import LAST_BAND, RISK_BANDS
from underwrite.functions.parsing import col, dec

POINTS_TO_DOUBLE_ODDS = 20.0
BASE_POINTS = 600.0
BASE_ODDS = 50.0


def point_factor(pdo: float = POINTS_TO_DOUBLE_ODDS) -> float:
    return pdo / math.log(2.0)


def point_offset(base: float = BASE_POINTS, odds: float = BASE_ODDS, pdo: float = POINTS_TO_DOUBLE_ODDS) -> float:
    return base - point_factor(pdo) * math.log(odds)


def clip(c: Column | str, low: float, high: float) -> Column:
    """Value held inside ``[low, high]``; NULL and NaN (which sorts above everything) stay."""
    value = col(c).cast("double")
    over = (value > high) & ~F.isnan(value)
    return F.when(value < low, dec(low)).when(over, dec(high)).otherwise(value)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient that is NULL unless the denominator is positive."""
    below = col(denominator)
    return F.when(below > 0, col(numerator) / below)


def share(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient with an empty denominator counted as zero."""
    return F.coalesce(F.try_divide(col(numerator).cast("double"), col(denominator).cast("double")), dec(0))


def annuity(amount: Column | str, rate_percent: Column | str, term: Column | str) -> Column:
    """Constant monthly payment of a loan."""
    p, n = col(amount), col(term)
    r = col(rate_percent) / dec(1200)
    return F.when(r == 0, p / n).otherwise(p * r / (dec(1) - F.pow(dec(1) + r, -n)))


def risk_band(p: Column | str) -> Column:
    """Letter of a probability; NULL has no band."""
    pd_ = col(p)
    limit, letter = RISK_BANDS[0]
    chain = F.when(pd_ < limit, letter)
    for limit, letter in RISK_BANDS[1:]:
        chain = chain.when(pd_ < limit, letter)
    return chain.when(pd_.isNotNull(), LAST_BAND)


def pd_to_points(p: Column | str) -> Column:
    q = clip(p, 1e-9, 1 - 1e-9)
    return dec(point_offset()) + dec(point_factor()) * F.log((dec(1) - q) / q)


def points_to_pd(points: Column | str) -> Column:
    return dec(1) / (dec(1) + F.exp((col(points) - dec(point_offset())) / dec(point_factor())))


def log_loss(y: Column | str, p: Column | str) -> Column:
    """Loss of one row at a probability already inside (0, 1)."""
    label, prob = col(y).cast("double"), col(p)
    return -(label * F.log(prob) + (dec(1) - label) * F.log(dec(1) - prob))


def misclassified(y: Column | str, p: Column | str, threshold: float | Column) -> Column:
    return ((col(p) >= threshold).cast("int") != col(y).cast("int")).cast("int")


def digitize(x: Column, edges: Sequence[float] | Column) -> Column:
    """Number of edges that are not above ``x`` (edges ascending); NULL in, NULL out.

    A short literal list becomes a sum of comparisons, which stays inside generated code.
    """
    if isinstance(edges, Column):
        return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: e <= x)))
    if not edges:
        return F.when(x.isNotNull(), F.lit(0))
    total = (x >= dec(edges[0])).cast("int")
    for edge in edges[1:]:
        total = total + (x >= dec(edge)).cast("int")
    return total


def evenly_spaced(low: float, high: float, points: int) -> list[float]:
    """``points`` equally spaced values, the last one exact."""
    step = (high - low) / (points - 1)
    return [low + i * step for i in range(points - 1)] + [high]

"""Exact quantiles of many columns at once, by rank instead of by collecting values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwrite.functions.parsing import dec
from underwrite.operators.scan import running_total, with_range


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n) of the non-null values; a NULL key is a group."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return rows.groupBy(*keys, F.col(value).cast("double").alias(value)).agg(F.count(F.lit(1)).alias("n"))


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(keys, q, n): linear-interpolation quantiles as an array in the order of ``probs``.

    The value at a rank is the smallest value whose cumulative count reaches it, so each of the
    ``2 * len(probs)`` ranks is one conditional minimum and no group is ever gathered.
    """
    cumulative = running_total(with_range(counts, [value], grouped=True), keys, [value], {"upto": F.col("n")}, {"upto": "size"})
    picks = []
    for i, p in enumerate(probs):
        position = dec(p) * (F.col("size") - 1)
        for tag, zero_based in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            reached = F.col("upto") >= zero_based + 1
            picks.append(F.min(F.when(reached, F.col(value))).alias(f"_{tag}{i}"))
    grouped = cumulative.groupBy(*keys).agg(F.max("size").alias("n"), *picks)

    def interpolated(i: int, p: float):
        position = dec(p) * (F.col("n") - 1)
        fraction = position - F.floor(position)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return low + (high - low) * fraction

    return grouped.select(*keys, F.array(*[interpolated(i, p) for i, p in enumerate(probs)]).alias("q"), "n")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    return quantiles_of_counts(value_counts(df, keys, value), keys, value, probs)

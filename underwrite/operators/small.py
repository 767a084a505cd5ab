"""Joins on grouping keys, and attaching tiny aggregate frames to big ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], match: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Columns of ``right`` next to ``left``; NULL in ``keys`` is a group of its own, ``match`` compares plainly."""
    on = F.lit(True)
    for name in match:
        on &= F.col(f"l.`{name}`") == F.col(f"r.`{name}`")
    for key in keys:
        on &= F.col(f"l.`{key}`").eqNullSafe(F.col(f"r.`{key}`"))
    added = [F.col(f"r.`{c}`") for c in right.columns if c not in (*keys, *match)]
    return left.alias("l").join(right.alias("r"), on, how).select("l.*", *added)


def attach(df: DataFrame, few: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of a one-row-per-key frame next to every row of ``df``.

    Without keys the single row arrives as one scalar subquery. With keys it is an equi-join that
    AQE turns into a broadcast only when the measured size of ``few`` allows it.
    """
    if keys:
        return join_keys(df, few.select(*keys, *columns), keys, how="left")
    row = few.select(F.struct(*columns).alias("_row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in columns])

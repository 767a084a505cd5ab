"""Label counts per distinct score, the base of every ranking metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite.functions.parsing import col, dec
from underwrite.operators.scan import RANGE, running_total, with_range


def score_counts(
    df: DataFrame, label: Column | str, score: Column | str, keys: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """(keys, score, pos, neg): one row per distinct score, partially aggregated before the shuffle; a NULL key is a group."""
    y = col(label).cast("int")
    w = F.lit(1).cast("bigint") if weight is None else weight
    rows = df.select(*keys, y.alias("_y"), col(score).cast("double").alias("score"), w.alias("_w"))
    rows = rows.filter(F.col("_y").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    return rows.groupBy(*keys, "score").agg(
        F.sum(F.col("_w") * F.col("_y")).alias("pos"), F.sum(F.col("_w") * (1 - F.col("_y"))).alias("neg")
    )


def ranked(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add cumulative counts up to and including each score, and the key totals.

    Columns: ``pos_cum``, ``neg_cum``, ``pos_all``, ``neg_all``.
    """
    return running_total(
        with_range(counts, ["score"], grouped=True),
        keys,
        ["score"],
        {"pos_cum": F.col("pos"), "neg_cum": F.col("neg")},
        {"pos_cum": "pos_all", "neg_cum": "neg_all"},
    ).drop(RANGE)


def neg_below() -> Column:
    """Negatives under a score plus half of those tied with it."""
    return F.col("neg_cum") - F.col("neg") / dec(2)


def pos_below() -> Column:
    return F.col("pos_cum") - F.col("pos") / dec(2)


def average_rank(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values with the mean rank their rows share (first rank is 1)."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("score"))
    tied = rows.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"))
    cumulative = running_total(with_range(tied, ["score"], grouped=True), keys, ["score"], {"upto": F.col("n")})
    return cumulative.select(
        *keys, F.col("score").alias(value), "n", (F.col("upto") - (F.col("n") - 1) / dec(2)).alias("avg_rank")
    )

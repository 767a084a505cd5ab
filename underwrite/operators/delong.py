"""DeLong inference for AUC from placement values.

The placement of a row is the share of the other class it outranks (ties count one half). It
depends on the score only, so it is computed once per distinct score.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite.config import Z_95
from underwrite.functions.parsing import col, dec
from underwrite.functions.stats import two_sided_p
from underwrite.operators.counts import neg_below, pos_below, ranked, score_counts
from underwrite.operators.metrics import auc_of, both_classes, rank_terms
from underwrite.operators.small import join_keys


def _spread(sum_: Column, squares: Column, n: Column) -> Column:
    """Sample variance from moments; NULL under two observations."""
    size = n.cast("double")
    return F.when(n > 1, (squares - sum_ * sum_ / size) / (size - 1))


def auc_interval(
    df: DataFrame, label: Column | str, score: Column | str, keys: Sequence[str] = (), z: float = Z_95
) -> DataFrame:
    """(keys, n, n_pos, auc, se, ci_low, ci_high); NULL statistics when a key has one class only."""
    moments = ranked(score_counts(df, label, score, keys), keys).groupBy(*keys).agg(*rank_terms())
    return interval_of_moments(moments, keys, z)


def interval_of_moments(moments: DataFrame, keys: Sequence[str], z: float = Z_95) -> DataFrame:
    m, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    variance = F.coalesce(_spread(F.col("u"), F.col("u2"), F.col("n_pos")), dec(0)) / (n * n * m) + F.coalesce(
        _spread(F.col("v"), F.col("v2"), F.col("n_neg")), dec(0)
    ) / (m * m * n)
    out = moments.withColumns({"auc": auc_of(), "se": both_classes(F.sqrt(F.greatest(variance, dec(0))))})
    return out.select(
        *keys,
        (F.col("n_pos") + F.col("n_neg")).alias("n"),
        "n_pos",
        "auc",
        "se",
        F.greatest(F.col("auc") - dec(z) * F.col("se"), dec(0)).alias("ci_low"),
        F.least(F.col("auc") + dec(z) * F.col("se"), dec(1)).alias("ci_high"),
    )


def long_scores(df: DataFrame, label: Column | str, scores: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, y, model, p): one row per row and score column."""
    ids = [F.col(k) for k in keys] + [F.col("y")]
    wide = df.select(*keys, col(label).cast("int").alias("y"), *scores)
    return wide.unpivot(ids, list(scores), "model", "p")


def auc_table(
    df: DataFrame, label: Column | str, scores: Sequence[str], keys: Sequence[str] = (), z: float = Z_95
) -> DataFrame:
    """AUC with interval of every score column in one pass."""
    return auc_interval(long_scores(df, label, scores, keys), "y", "p", [*keys, "model"], z)


def paired_moments(df: DataFrame, label: Column | str, scores: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per key with the joint placement moments of all score columns.

    Identical score tuples collapse first. Each score column then meets its ranked counts in an
    equi-join on the score; the ranked side has unique keys, so a hot score only makes one
    partition of the tuple side large, which AQE splits.
    """
    y = col(label).cast("int")
    rows = df.select(*keys, y.alias("_y"), *[F.col(s).cast("double").alias(s) for s in scores])
    for name in ("_y", *scores):
        rows = rows.filter(F.col(name).isNotNull())
    tuples = rows.groupBy(*keys, *scores).agg(
        F.sum(F.col("_y").cast("bigint")).alias("w_pos"), F.sum((1 - F.col("_y")).cast("bigint")).alias("w_neg")
    )
    placed_tuples = tuples
    for s in scores:
        # From the tuples, not the rows: all score columns share the one exchange of the tuples.
        counts = tuples.groupBy(*keys, F.col(s).alias("score")).agg(
            F.sum("w_pos").alias("pos"), F.sum("w_neg").alias("neg")
        )
        placed = ranked(counts, keys).select(
            *keys,
            F.col("score").alias(s),
            F.try_divide(neg_below(), F.col("neg_all").cast("double")).alias(f"_a_{s}"),
            F.try_divide(pos_below(), F.col("pos_all").cast("double")).alias(f"_b_{s}"),
        )
        placed_tuples = join_keys(placed_tuples, placed, keys, [s])
    aggregates = [F.sum("w_pos").alias("n_pos"), F.sum("w_neg").alias("n_neg")]
    for side, weight in (("a", "w_pos"), ("b", "w_neg")):
        for i, s in enumerate(scores):
            x = F.col(f"_{side}_{s}")
            aggregates.append(F.sum(F.col(weight) * x).alias(f"{side}{i}"))
            for j in range(i, len(scores)):
                other = F.col(f"_{side}_{scores[j]}")
                aggregates.append(F.sum(F.col(weight) * x * other).alias(f"{side}{i}_{j}"))
    return placed_tuples.groupBy(*keys).agg(*aggregates)


def _covariance(side: str, i: int, j: int, n: Column) -> Column:
    i, j = min(i, j), max(i, j)
    size = n.cast("double")
    product = F.col(f"{side}{i}") * F.col(f"{side}{j}") / size
    return F.coalesce(F.when(n > 1, (F.col(f"{side}{i}_{j}") - product) / (size - 1)), dec(0)) / size


def paired_tests(
    df: DataFrame,
    label: Column | str,
    scores: Sequence[str],
    keys: Sequence[str] = (),
    pairs: Sequence[tuple[str, str]] | None = None,
    z_value: float = Z_95,
) -> DataFrame:
    """Paired comparison of score columns on the same rows.

    (keys, pair, model_a, model_b, auc_a, auc_b, delta, se, z, p_value, ci_low, ci_high), pairs in
    the order of ``scores`` unless given. No variance means z = 0 and p = 1.
    """
    index = {s: i for i, s in enumerate(scores)}
    if pairs is None:
        pairs = [(a, b) for i, a in enumerate(scores) for b in scores[i + 1 :]]
    moments = paired_moments(df, label, scores, keys)
    n_pos, n_neg = F.col("n_pos"), F.col("n_neg")

    def auc(i: int) -> Column:
        return both_classes(F.col(f"a{i}") / n_pos.cast("double"))

    rows = []
    for order, (first, second) in enumerate(pairs):
        i, j = index[first], index[second]
        variance = reduce(
            lambda total, part: total + part,
            [
                _covariance(side, i, i, n) + _covariance(side, j, j, n) - _covariance(side, i, j, n) * 2
                for side, n in (("a", n_pos), ("b", n_neg))
            ],
        )
        rows.append(
            F.struct(
                F.lit(order + 1).alias("pair"),
                F.lit(first).alias("model_a"),
                F.lit(second).alias("model_b"),
                auc(i).alias("auc_a"),
                auc(j).alias("auc_b"),
                both_classes(variance).alias("variance"),
            )
        )
    listed = moments.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")
    spread = F.col("variance") > 1e-18
    tested = listed.withColumn("delta", F.col("auc_a") - F.col("auc_b")).withColumn(
        "se", F.when(spread, F.sqrt("variance")).when(F.col("variance").isNotNull(), dec(0))
    )
    tested = tested.withColumn("z", F.when(spread, F.col("delta") / F.col("se")).when(F.col("se") == 0, dec(0)))
    return tested.withColumn("p_value", two_sided_p("z")).select(
        *keys,
        "pair",
        "model_a",
        "model_b",
        "auc_a",
        "auc_b",
        "delta",
        "se",
        "z",
        "p_value",
        (F.col("delta") - dec(z_value) * F.col("se")).alias("ci_low"),
        (F.col("delta") + dec(z_value) * F.col("se")).alias("ci_high"),
    )

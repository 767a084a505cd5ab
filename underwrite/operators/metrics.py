"""Classification metrics as one aggregate over ranked score counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from underwrite.functions.parsing import col, dec
from underwrite.functions.scoring import clip, digitize, evenly_spaced, share
from underwrite.operators.counts import neg_below, pos_below, ranked, score_counts
from underwrite.operators.scan import RANGE, following, row_numbers, with_range

PROBABILITY_FLOOR = 1e-7
ECE_EDGES = tuple(evenly_spaced(0.0, 1.0, 11)[1:-1])
THRESHOLD_GRID = tuple(evenly_spaced(0.02, 0.9, 89))
CURVE_GRID = tuple(round(t, 3) for t in evenly_spaced(0.02, 0.60, 59))


def both_classes(value: Column) -> Column:
    return F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), value)


def rank_terms() -> list[Column]:
    """Aggregates every AUC-type result is made of."""
    above, below = neg_below(), pos_below()
    return [
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * above).alias("u"),
        F.sum(F.col("pos") * above * above).alias("u2"),
        F.sum(F.col("neg") * below).alias("v"),
        F.sum(F.col("neg") * below * below).alias("v2"),
    ]


def separation() -> Column:
    """Largest gap of the two cumulative distributions."""
    gap = F.try_divide(F.col("pos_cum"), F.col("pos_all").cast("double")) - F.try_divide(
        F.col("neg_cum"), F.col("neg_all").cast("double")
    )
    return F.max(F.abs(gap))


def average_precision() -> Column:
    """Precision at each distinct score, weighted by the recall it adds."""
    hits = F.col("pos_all") - F.col("pos_cum") + F.col("pos")
    alarms = F.col("neg_all") - F.col("neg_cum") + F.col("neg")
    return F.sum(F.col("pos") / F.col("pos_all").cast("double") * (hits / (hits + alarms).cast("double")))


def auc_of(u: str = "u") -> Column:
    return both_classes(F.col(u) / (F.col("n_pos").cast("double") * F.col("n_neg")))


def classification_report(
    df: DataFrame, label: Column | str, score: Column | str, threshold: float = 0.5, keys: Sequence[str] = ()
) -> DataFrame:
    """The full metric row per key from a single ranked scan of distinct scores."""
    p = clip(score, PROBABILITY_FLOOR, 1 - PROBABILITY_FLOOR)
    rows = ranked(score_counts(df, label, p, keys), keys)
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    size, flagged = pos + neg, s >= threshold
    bins = digitize(s, ECE_EDGES)
    ece_terms = [
        F.sum(F.when(bins == b, size * s - pos)).alias(f"_gap{b}") for b in range(len(ECE_EDGES) + 1)
    ]
    parts = rows.groupBy(*keys).agg(
        *rank_terms(),
        separation().alias("_ks"),
        average_precision().alias("_ap"),
        F.sum(pos * (1 - s) * (1 - s) + neg * s * s).alias("_sq"),
        F.sum(-(pos * F.log(s) + neg * F.log(1 - s))).alias("_ll"),
        F.sum(size * s).alias("_sum_p"),
        F.sum(F.when(flagged, pos).otherwise(0)).alias("tp"),
        F.sum(F.when(flagged, neg).otherwise(0)).alias("fp"),
        *ece_terms,
    )
    n = (F.col("n_pos") + F.col("n_neg")).cast("double")
    precision, recall = share("tp", F.col("tp") + F.col("fp")), share("tp", "n_pos")
    gaps = sum((F.abs(F.coalesce(F.col(f"_gap{b}"), dec(0))) for b in range(len(ECE_EDGES) + 1)), dec(0))
    return parts.select(
        *keys,
        (F.col("n_pos") + F.col("n_neg")).alias("n"),
        "n_pos",
        auc_of().alias("roc_auc"),
        (auc_of() * 2 - 1).alias("gini"),
        both_classes(F.col("_ap")).alias("pr_auc"),
        both_classes(F.col("_ks")).alias("ks"),
        (F.col("_sq") / n).alias("brier"),
        (F.col("_ll") / n).alias("log_loss"),
        (gaps / n).alias("ece"),
        precision.alias("precision"),
        recall.alias("recall"),
        share(precision * recall * 2, precision + recall).alias("f1"),
        (F.col("n_pos") / n).alias("default_rate_observed"),
        (F.col("_sum_p") / n).alias("default_rate_predicted"),
    )


def threshold_counts(
    df: DataFrame, label: Column | str, score: Column | str, grid: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, step, threshold, tp, fp, fn, tn) for each grid value.

    Rows collapse to one count per grid step before anything else happens, so no row ever meets
    the grid; the grid itself only joins those few counts.
    """
    y = col(label).cast("int")
    rows = df.filter(y.isNotNull() & col(score).isNotNull())
    histogram = rows.groupBy(*keys, digitize(col(score).cast("double"), list(grid)).alias("step")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")
    )
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(grid)))).alias("step")
    zero = F.lit(0).cast("bigint")
    blank = histogram.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, steps, zero.alias("pos"), zero.alias("neg")
    )
    dense = histogram.unionByName(blank).groupBy(*keys, "step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # At most len(grid) + 1 rows per key from here on.
    upward = W.partitionBy(*keys).orderBy(F.col("step").desc()).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    values = F.array(*[dec(t) for t in grid])
    return (
        dense.select(
            *keys,
            "step",
            F.sum("pos").over(upward).alias("tp"),
            F.sum("neg").over(upward).alias("fp"),
            F.sum("pos").over(whole).alias("_p"),
            F.sum("neg").over(whole).alias("_n"),
        )
        .filter(F.col("step") > 0)
        .select(
            *keys,
            "step",
            F.element_at(values, F.col("step")).alias("threshold"),
            "tp",
            "fp",
            (F.col("_p") - F.col("tp")).alias("fn"),
            (F.col("_n") - F.col("fp")).alias("tn"),
        )
    )


def optimal_threshold(
    df: DataFrame,
    label: Column | str,
    score: Column | str,
    cost_fn: float = 5.0,
    cost_fp: float = 1.0,
    keys: Sequence[str] = (),
    grid: Sequence[float] = THRESHOLD_GRID,
) -> DataFrame:
    """Cheapest grid threshold; the lowest one when several cost the same."""
    cost = F.col("fn") * dec(cost_fn) + F.col("fp") * dec(cost_fp)
    best = F.min(F.struct(cost.alias("cost"), F.col("threshold"))).alias("b")
    return threshold_counts(df, label, score, grid, keys).groupBy(*keys).agg(best).select(
        *keys, F.col("b.threshold").alias("threshold"), F.col("b.cost").alias("cost")
    )


def threshold_curve(
    df: DataFrame,
    label: Column | str,
    score: Column | str,
    cost_fn: float = 5.0,
    cost_fp: float = 1.0,
    keys: Sequence[str] = (),
    grid: Sequence[float] = CURVE_GRID,
) -> DataFrame:
    """Approval, quality of the approved and expected cost at each rejection threshold."""
    n = (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).cast("double")
    approved = (F.col("fn") + F.col("tn")).cast("double")
    return threshold_counts(df, label, score, grid, keys).select(
        *keys,
        "threshold",
        (approved / n).alias("approval_rate"),
        F.try_divide(F.col("fn"), approved).alias("bad_rate_approved"),
        share("tp", F.col("tp") + F.col("fn")).alias("recall"),
        share("tp", F.col("tp") + F.col("fp")).alias("precision"),
        ((F.col("fn") * dec(cost_fn) + F.col("fp") * dec(cost_fp)) / n).alias("expected_cost"),
    )


def diagnose_fit(train_auc: Column | str, test_auc: Column | str, gap_limit: float = 0.07, floor: float = 0.65) -> Column:
    gap = col(train_auc) - col(test_auc)
    weak = (col(train_auc) < floor) & (col(test_auc) < floor)
    return F.when(gap > gap_limit, "sobreajuste").when(weak, "subajuste").otherwise("buen_ajuste")


def curve_points(
    df: DataFrame, label: Column | str, score: Column | str, points: int = 200, keys: Sequence[str] = ()
) -> DataFrame:
    """ROC and precision-recall points from strict to lenient, thinned evenly by position.

    Position 0 is the empty origin, so a key with ``size`` distinct scores has the positions
    0..size; those that ``points`` equal steps over that range truncate to are kept.
    """
    rows = ranked(score_counts(df, label, score, keys), keys).withColumns(
        {
            "_hits": F.col("pos_all") - F.col("pos_cum") + F.col("pos"),
            "_alarms": F.col("neg_all") - F.col("neg_cum") + F.col("neg"),
            "_down": -F.col("score"),
        }
    )
    numbered = row_numbers(rows, keys, ["_down"], "position", "size")
    steps = points - 1
    step = F.floor((F.col("position") * steps + F.col("size") - 1) / F.col("size"))
    kept = F.floor(step * F.col("size") / steps) == F.col("position")
    hits, alarms = F.col("_hits"), F.col("_alarms")
    return numbered.filter(kept).select(
        *keys,
        "position",
        F.col("score").alias("threshold"),
        F.try_divide(alarms, F.col("neg_all").cast("double")).alias("fpr"),
        F.try_divide(hits, F.col("pos_all").cast("double")).alias("tpr"),
        F.try_divide(hits, (hits + alarms).cast("double")).alias("precision"),
    )


def roc_corners(
    df: DataFrame, label: Column | str, score: Column | str, points: int = 200, keys: Sequence[str] = ()
) -> DataFrame:
    """ROC points where the curve turns, from strict to lenient, thinned evenly by position among them.

    A point lies on a straight line if the step to it equals the step after it, that is if the next lower score has
    the same counts of both classes; the first and the last point always stay. Position 0 is the empty origin.
    """
    rows = ranked(score_counts(df, label, score, keys), keys).withColumn("_down", -F.col("score"))
    counts = F.struct("pos", "neg")
    ahead = following(with_range(rows, ["_down"]), keys, ["_down"], counts, "_ahead").drop(RANGE)
    first = (F.col("pos_cum") == F.col("pos_all")) & (F.col("neg_cum") == F.col("neg_all"))
    corners = ahead.filter(first | F.col("_ahead").isNull() | (F.col("_ahead") != counts))
    numbered = row_numbers(corners, keys, ["_down"], "position", "size")
    steps = points - 1
    step = F.floor((F.col("position") * steps + F.col("size") - 1) / F.col("size"))
    hits, alarms = F.col("pos_all") - F.col("pos_cum") + F.col("pos"), F.col("neg_all") - F.col("neg_cum") + F.col("neg")
    return numbered.filter(F.floor(step * F.col("size") / steps) == F.col("position")).select(
        *keys,
        "position",
        F.col("score").alias("threshold"),
        F.try_divide(alarms, F.col("neg_all").cast("double")).alias("fpr"),
        F.try_divide(hits, F.col("pos_all").cast("double")).alias("tpr"),
    )

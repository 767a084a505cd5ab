"""Portfolio analysis of a score: calibration, gains, vintages, attribution."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from underwrite.functions.calendar import quarter_label
from underwrite.functions.parsing import col, dec
from underwrite.functions.scoring import clip, digitize
from underwrite.functions.stats import two_sided_p, wilson
from underwrite.operators.bootstrap import bootstrap_interval
from underwrite.operators.counts import average_rank, ranked, score_counts
from underwrite.operators.delong import auc_interval, interval_of_moments
from underwrite.operators.metrics import classification_report, rank_terms, separation
from underwrite.operators.quantiles import quantiles_of_counts
from underwrite.operators.scan import ntile
from underwrite.operators.small import attach, join_keys
from underwrite.session import materialize

CALIBRATION_FLOOR = 1e-6


def calibration_counts(df: DataFrame, label: Column | str, score: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    return score_counts(df, label, clip(score, CALIBRATION_FLOOR, 1 - CALIBRATION_FLOOR), keys)


def calibration_summary(df: DataFrame, label: Column | str, score: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    """Brier score with its reference, Spiegelhalter test and both rates."""
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    n = pos + neg
    tilt = dec(1) - s * 2
    sums = calibration_counts(df, label, score, keys).groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.sum(pos).alias("_pos"),
        F.sum(n * s).alias("_p"),
        F.sum(pos * (1 - s) * (1 - s) + neg * s * s).alias("_sq"),
        F.sum((pos - n * s) * tilt).alias("_num"),
        F.sum(n * tilt * tilt * s * (1 - s)).alias("_den"),
    )
    rate = F.col("_pos") / F.col("n").cast("double")
    z = F.when(F.col("_den") > 0, F.col("_num") / F.sqrt("_den")).otherwise(dec(0))
    return sums.withColumn("spiegelhalter_z", z).select(
        *keys,
        "n",
        (F.col("_sq") / F.col("n")).alias("brier"),
        (rate * (1 - rate)).alias("brier_reference"),
        "spiegelhalter_z",
        two_sided_p("spiegelhalter_z").alias("spiegelhalter_p"),
        (F.col("_p") / F.col("n")).alias("mean_pd"),
        rate.alias("observed_rate"),
    )


def reliability_table(
    df: DataFrame, label: Column | str, score: Column | str, bins: int = 10, keys: Sequence[str] = ()
) -> DataFrame:
    """Observed rate per quantile bin; bins without rows do not appear."""
    counts = calibration_counts(df, label, score, keys).withColumn("n", F.col("pos") + F.col("neg"))
    edges = quantiles_of_counts(counts, keys, "score", [i / bins for i in range(bins + 1)])
    distinct = F.array_distinct("q")
    inner = edges.select(*keys, F.slice(distinct, 2, F.greatest(F.size(distinct) - 2, F.lit(0))).alias("inner"))
    rows = attach(counts, inner, keys, ["inner"])
    table = rows.groupBy(*keys, (digitize(F.col("score"), F.col("inner")) + 1).alias("bin")).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("k"), F.sum(F.col("n") * F.col("score")).alias("_p")
    )
    low, high = wilson("k", "n")
    return table.select(
        *keys,
        "bin",
        "n",
        (F.col("_p") / F.col("n")).alias("mean_pd"),
        (F.col("k") / F.col("n").cast("double")).alias("observed"),
        low.alias("ci_low"),
        high.alias("ci_high"),
    )


def calibration_line(
    df: DataFrame, label: Column | str, score: Column | str, iterations: int = 25, tolerance: float = 1e-10
) -> DataFrame:
    """Slope and intercept of the outcome on the score's log-odds.

    Newton steps on label counts per distinct score, written once and then read per step; each
    step brings five sums to the driver. Steps that would lower the likelihood are halved. Without a spread of scores
    or without both outcomes there is no line: slope and intercept are NULL. A fit that has not settled after
    ``iterations`` steps raises.
    """
    logit = F.log(F.col("score") / (dec(1) - F.col("score")))
    counts = materialize(
        calibration_counts(df, label, score).select(logit.alias("x"), "pos", "neg"), "calibration"
    )
    size, x = F.col("pos") + F.col("neg"), F.col("x")

    def sums(intercept: float, slope: float) -> tuple[float, ...]:
        z = dec(intercept) + dec(slope) * x
        fitted = dec(1) / (dec(1) + F.exp(-z))
        residual, weight = F.col("pos") - size * fitted, size * fitted * (1 - fitted)
        # log(1 + exp(z)) without overflow
        loss = size * (F.greatest(z, dec(0)) + F.log1p(F.exp(-F.abs(z)))) - F.col("pos") * z
        return counts.agg(
            F.sum(residual), F.sum(residual * x), F.sum(weight), F.sum(weight * x), F.sum(weight * x * x), F.sum(loss), F.sum("pos"), F.sum("neg")
        ).first()

    intercept, slope = 0.0, 1.0
    now = sums(intercept, slope)
    known = bool(now[6] and now[7]) and counts.agg(F.min("x") < F.max("x")).first()[0]
    settled = not known
    for _ in range(iterations if known else 0):
        g0, g1, h00, h01, h11 = now[:5]
        det = h00 * h11 - h01 * h01
        if det <= 0:
            break
        up0, up1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        settled = math.hypot(up0, up1) < tolerance
        then = sums(intercept + up0, slope + up1)
        while not settled and then[5] > now[5] and math.hypot(up0, up1) > tolerance:
            up0, up1 = up0 / 2, up1 / 2
            then = sums(intercept + up0, slope + up1)
        intercept, slope, now = intercept + up0, slope + up1, then
        if settled:
            break
    if not settled:
        raise ArithmeticError(f"the calibration line has not settled after {iterations} steps (intercept {intercept:.4g}, slope {slope:.4g})")
    line = [dec(v) if known else F.lit(None).cast("double") for v in (slope, intercept)]
    return counts.agg(F.sum(size).alias("n")).select("n", line[0].alias("slope"), line[1].alias("intercept"))


def calibration_verdict(spiegelhalter_p: Column, intercept: Column, mean_pd: Column, observed: Column) -> Column:
    off = (spiegelhalter_p < 0.05) | (F.abs(intercept) > 0.05)
    return F.when(off, F.when(mean_pd > observed, "sobreestima").otherwise("subestima")).otherwise("adecuada")


def decile_table(
    df: DataFrame,
    label: Column | str,
    score: Column | str,
    order_id: Column | str,
    tiles: int = 10,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Gains table, tile 1 the riskiest. ``order_id`` (numeric, unique) breaks score ties."""
    rows = df.select(
        *keys,
        col(label).cast("int").alias("y"),
        col(score).cast("double").alias("p"),
        (-col(score).cast("double")).alias("_down"),
        col(order_id).alias("_id"),
    ).filter(F.col("y").isNotNull() & F.col("p").isNotNull())
    tiled = ntile(rows, keys, ["_down", "_id"], tiles, "decile")
    table = tiled.groupBy(*keys, "decile").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad"), F.avg("p").alias("mean_pd")
    )
    whole = W.partitionBy(*keys)
    upto = whole.orderBy("decile").rowsBetween(W.unboundedPreceding, 0)
    bad, n = F.col("bad").cast("double"), F.col("n").cast("double")
    low, high = wilson("bad", "n")
    return table.select(
        *keys,
        "decile",
        "n",
        (bad / n).alias("default_rate"),
        low.alias("ci_low"),
        high.alias("ci_high"),
        "mean_pd",
        F.try_divide(F.sum(bad).over(upto), F.sum(bad).over(whole)).alias("cum_capture"),
        (F.sum(n).over(upto) / F.sum(n).over(whole)).alias("cum_population"),
        F.try_divide(bad / n, F.sum(bad).over(whole) / F.sum(n).over(whole)).alias("lift"),
    )


def vintage_stability(
    df: DataFrame,
    label: Column | str,
    score: Column | str,
    issued: Column | str,
    min_defaults: int = 30,
    keys: Sequence[str] = (),
) -> DataFrame:
    """AUC with interval, separation and both rates per issue quarter.

    Quarters with fewer than ``min_defaults`` defaults or with one class are left out.
    """
    by = [*keys, "quarter"]
    rows = df.select(*keys, quarter_label(issued).alias("quarter"), col(label).alias("y"), col(score).alias("p"))
    moments = ranked(score_counts(rows, "y", "p", by), by).groupBy(*by).agg(
        *rank_terms(),
        separation().alias("ks"),
        F.sum((F.col("pos") + F.col("neg")) * F.col("score")).alias("_p"),
    )
    kept = moments.filter((F.col("n_pos") >= min_defaults) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    interval = interval_of_moments(kept, [*by, "_p", "ks"])
    return interval.select(
        *by,
        "n",
        "auc",
        "ci_low",
        "ci_high",
        "ks",
        (F.col("n_pos") / F.col("n").cast("double")).alias("observed"),
        (F.col("_p") / F.col("n")).alias("mean_pd"),
    )


def vintage_summary(vintages: DataFrame) -> DataFrame:
    return vintages.agg(
        F.min("auc").alias("auc_min"),
        F.max("auc").alias("auc_max"),
        F.count(F.lit(1)).alias("n_vintages"),
        F.max("quarter").alias("last_quarter"),
        F.max_by("mean_pd", "quarter").alias("last_mean_pd"),
        F.max_by("observed", "quarter").alias("last_observed"),
    )


def spearman(
    df: DataFrame, keys: Sequence[str], x: str, y: str, min_rows: int = 10
) -> DataFrame:
    """Rank correlation of ``x`` and ``y`` per key; NULL up to ``min_rows`` rows or without spread in x."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    pairs = rows.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_w"))
    for side in ("_x", "_y"):
        ranks = average_rank(rows, side, keys).select(*keys, side, F.col("avg_rank").alias(f"r{side}"))
        pairs = join_keys(pairs, ranks, keys, [side])
    a, b, w = F.col("r_x"), F.col("r_y"), F.col("_w")
    sums = pairs.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        F.sum(w * a).alias("sa"),
        F.sum(w * b).alias("sb"),
        F.sum(w * a * a).alias("saa"),
        F.sum(w * b * b).alias("sbb"),
        F.sum(w * a * b).alias("sab"),
    )
    n = F.col("n").cast("double")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    value = F.when((F.col("n") > min_rows) & (va > 0), F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)))
    return sums.select(*keys, "n", value.alias("spearman"))


def split_summary(df: DataFrame, split: str, date: str, target: str) -> DataFrame:
    return df.groupBy(split).agg(
        F.min(date).alias("first_month"),
        F.max(date).alias("last_month"),
        F.count(F.lit(1)).alias("n"),
        F.avg(target).alias("default_rate"),
    )


def gini_kept(auc_full: Column | str, auc_without: Column | str) -> Column:
    """Share of ranking power above chance that survives an ablation."""
    full, without = col(auc_full) - dec(0.5), col(auc_without) - dec(0.5)
    return F.when(full > 0, without / full)


def nearest_threshold(curve: DataFrame, chosen: float, keys: Sequence[str] = ()) -> DataFrame:
    """The curve row closest to a chosen threshold; the lower one when two are equally near."""
    others = [c for c in curve.columns if c not in keys]
    distance = F.struct(F.abs(F.col("threshold") - dec(chosen)), F.col("threshold"))
    return curve.groupBy(*keys).agg(F.min_by(F.struct(*others), distance).alias("r")).select(*keys, "r.*")


def discrimination_block(
    df: DataFrame, label: Column | str, score: Column | str, n: int = 300, keys: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """(keys, auc with its DeLong interval, gini, ks and pr_auc with bootstrap intervals, prevalence)."""
    one = [F.lit(1).alias("_one")]
    by = [*keys, "_one"]
    exact = auc_interval(df, label, score, keys).select(*keys, "auc", F.col("ci_low").alias("auc_ci_low"), F.col("ci_high").alias("auc_ci_high"))
    report = classification_report(df, label, score, keys=keys).select(*keys, "gini", "ks", "pr_auc", F.col("default_rate_observed").alias("prevalence"))
    drawn = bootstrap_interval(df, label, score, ("ks", "pr_auc"), n, keys=keys, seed=seed)
    limits = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in ("ks", "pr_auc") for c in ("ci_low", "ci_high")]
    drawn = drawn.groupBy(*keys).agg(*limits)
    parts = [d.select("*", *one) for d in (exact, report, drawn)]
    return join_keys(join_keys(parts[0], parts[1], by), parts[2], by).drop("_one")

"""Weight-of-evidence binning of all features at once, in long form."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from underwrite.config import SCORECARD_MISSING_CODE, SCORECARD_OTHER
from underwrite.functions.parsing import dec
from underwrite.functions.scoring import digitize
from underwrite.operators.preprocessing import long_numeric
from underwrite.operators.quantiles import quantiles_of_counts
from underwrite.session import materialize

SMOOTHING = 0.5


def labelled_counts(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(feature, value, pos, neg, n) per distinct numeric value, NULL value included."""
    long = long_numeric(df.filter(F.col(target).isNotNull()), columns, [target])
    value = F.when(~F.isnan("value"), F.col("value")).alias("value")
    y = F.col(target).cast("int")
    return long.groupBy("feature", value).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), F.count(F.lit(1)).alias("n")
    )


def candidate_edges(counts: DataFrame, max_bins: int = 10, max_discrete: int = 30) -> DataFrame:
    """(feature, edges): midpoints between neighbouring values, or just above each quantile.

    ``max_bins`` and ``max_discrete`` are the method's parameters: a feature with at most ``max_discrete`` distinct
    values is cut between all of them, any other at its ``max_bins`` quantiles.
    """
    known = counts.filter(F.col("value").isNotNull())
    probs = [i / max_bins for i in range(1, max_bins)]
    quantiles = quantiles_of_counts(known, ["feature"], "value", probs).select("feature", "q")
    sized = known.groupBy("feature").agg(F.count(F.lit(1)).alias("distinct"))
    facts = sized.join(quantiles, "feature")

    # Few values: at most max_discrete entries per feature are gathered.
    # One short row per feature: safe to broadcast whatever the number of loans.
    rows = known.select("feature", "value").join(F.broadcast(facts.select("feature", "distinct", "q")), "feature")
    few = rows.filter(F.col("distinct") <= max_discrete).groupBy("feature").agg(
        F.sort_array(F.collect_set("value")).alias("v")
    )
    discrete = few.select(
        "feature",
        F.zip_with(
            F.slice("v", 1, F.greatest(F.size("v") - 1, F.lit(0))),
            F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))),
            lambda a, b: (a + b) / dec(2),
        ).alias("edges"),
    )
    next_above = [
        F.min(F.when(F.col("value") > F.element_at("q", i + 1), F.col("value"))).alias(f"_n{i}")
        for i in range(len(probs))
    ]
    many = rows.filter(F.col("distinct") > max_discrete).groupBy("feature").agg(F.first("q").alias("q"), *next_above)
    midpoints = [(F.element_at("q", i + 1) + F.col(f"_n{i}")) / dec(2) for i in range(len(probs))]
    continuous = many.select("feature", F.sort_array(F.array_distinct(F.array_compact(F.array(*midpoints)))).alias("edges"))
    return discrete.unionByName(continuous)


def merge_small_bins(counts: DataFrame, edges: DataFrame, min_share: float = 0.01) -> DataFrame:
    """(feature, edges) after joining neighbours of bins under ``min_share`` of the known rows.

    Spark counts the rows per candidate bin; what is left is a fold over about thirty numbers per feature, an array
    expression of one row: the smallest bin (the first of equals) joins its smaller neighbour (the left of equals)
    until it is large enough or alone.
    """
    known = counts.filter(F.col("value").isNotNull()).join(F.broadcast(edges), "feature")
    sizes = known.groupBy("feature", "edges", digitize(F.col("value"), F.col("edges")).alias("code")).agg(F.sum("n").alias("n"))
    held = sizes.groupBy("feature").agg(
        F.any_value("edges").alias("cuts"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("held")
    )
    bins = "transform(sequence(0, size(cuts)), i -> struct(coalesce(try_element_at(held, i), 0L) as n, get(cuts, i) as edge))"
    smallest = "array_min(transform(b, x -> x.n))"
    at = f"array_position(transform(b, x -> x.n), {smallest})"
    # The pair that is joined starts at the smallest bin or at its left neighbour.
    left_first = "at > 1 and (at = size(b) or b[cast(at - 2 as int)].n <= b[cast(at as int)].n)"
    pair = f"cast(case when {left_first} then at - 1 else at end as int)"
    joined = "struct(b[f - 1].n + b[f].n as n, b[f].edge as edge)"
    merged = f"concat(slice(b, 1, f - 1), array({joined}), slice(b, f + 2, size(b)))"
    # ``let`` by a one-element transform: names for the position and the pair.
    merged = f"element_at(transform(array({at}), at -> element_at(transform(array({pair}), f -> {merged}), 1)), 1)"
    folded = f"aggregate(sequence(1, size(cuts)), {bins}, (b, k) -> case when size(b) > 1 and {smallest} < total * {min_share!r}D then {merged} else b end)"
    kept = F.when(F.size("cuts") > 0, F.expr(f"transform({folded}, x -> x.edge)")).otherwise(F.array().cast("array<double>"))
    return held.select("feature", F.array_compact(kept).alias("edges"))


def numeric_codes(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, code, pos, neg, n); NULL values get the missing code."""
    joined = counts.join(F.broadcast(edges), "feature", "left")
    cuts = F.coalesce("edges", F.array().cast("array<double>"))
    code = F.coalesce(digitize(F.col("value"), cuts), F.lit(SCORECARD_MISSING_CODE))
    return joined.groupBy("feature", code.alias("code")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("n").alias("n")
    )


def categorical_counts(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    long = df.filter(F.col(target).isNotNull()).select(target, *columns).unpivot(
        [target], list(columns), "feature", "value"
    )
    y = F.col(target).cast("int")
    return long.groupBy("feature", "value").agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), F.count(F.lit(1)).alias("n")
    )


def categorical_levels(counts: DataFrame, min_share: float = 0.01) -> DataFrame:
    """(feature, levels): frequent categories sorted, then the catch-all when something is rare.

    At most ``1 / min_share`` levels can be frequent, which bounds the gathered array.
    """
    known = counts.filter(F.col("value").isNotNull())
    totals = known.groupBy("feature").agg(F.sum("n").alias("total"))
    shares = known.join(F.broadcast(totals), "feature").withColumn("frequent", F.col("n") >= F.col("total") * dec(min_share))
    levels = shares.groupBy("feature").agg(
        F.sort_array(F.collect_set(F.when(F.col("frequent"), F.col("value")))).alias("levels"),
        F.max(~F.col("frequent")).alias("has_rare"),
    )
    catch_all = F.array(F.lit(SCORECARD_OTHER))
    extended = F.when(F.col("has_rare") | (F.size("levels") == 0), F.concat("levels", catch_all)).otherwise(F.col("levels"))
    return levels.select("feature", extended.alias("levels"))


def level_code(value: Column, levels: Column) -> Column:
    """0-based level number; unseen text is the catch-all, or one past the end without it."""
    own = F.array_position(levels, value)
    other = F.array_position(levels, SCORECARD_OTHER)
    fallback = F.when(other > 0, other - 1).otherwise(F.size(levels).cast("bigint"))
    code = F.when(own > 0, own - 1).otherwise(fallback).cast("int")
    return F.when(value.isNull(), F.lit(SCORECARD_MISSING_CODE)).otherwise(code)


def categorical_codes(counts: DataFrame, levels: DataFrame) -> DataFrame:
    joined = counts.join(F.broadcast(levels), "feature", "left")
    known = F.coalesce("levels", F.array(F.lit(SCORECARD_OTHER)))
    return joined.groupBy("feature", level_code(F.col("value"), known).alias("code")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("n").alias("n")
    )


def weight_of_evidence(coded: DataFrame) -> DataFrame:
    """Smoothed WoE and information value per (feature, code).

    ``coded`` has one row per feature and bin, so the window over a feature sees a few rows.
    """
    feature = W.partitionBy("feature")
    bins = F.count(F.lit(1)).over(feature) * dec(SMOOTHING)
    good = (F.col("neg") + dec(SMOOTHING)) / (F.sum("neg").over(feature) + bins)
    bad = (F.col("pos") + dec(SMOOTHING)) / (F.sum("pos").over(feature) + bins)
    rows = coded.select(
        "feature",
        "code",
        "n",
        (F.col("n") / F.sum("n").over(feature).cast("double")).alias("share"),
        (F.col("pos") / F.greatest(F.col("pos") + F.col("neg"), F.lit(1)).cast("double")).alias("bad_rate"),
        good.alias("_good"),
        bad.alias("_bad"),
    ).withColumn("woe", F.log(F.col("_good") / F.col("_bad")))
    return rows.withColumn("iv_contribution", (F.col("_good") - F.col("_bad")) * F.col("woe")).drop("_good", "_bad")


def iv_strength(iv: Column) -> Column:
    return (
        F.when(iv < 0.02, "inútil")
        .when(iv < 0.1, "débil")
        .when(iv < 0.3, "medio")
        .when(iv < 0.5, "fuerte")
        .otherwise("muy alto (> 0.5: verificar posible fuga)")
    )


def iv_table(woe: DataFrame) -> DataFrame:
    table = woe.groupBy("feature").agg(F.sum("iv_contribution").alias("iv"), F.count(F.lit(1)).alias("n_bins"))
    return table.select("feature", "iv", iv_strength(F.col("iv")).alias("strength"), "n_bins")


def short_number(c: Column) -> Column:
    """Four significant digits without trailing zeros; called on bin tables only."""

    def text(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else f"{v:.4g}" for v in values], dtype=object)

    return F.pandas_udf(text, T.StringType())(c)


def bin_label(code: Column, edges: Column, levels: Column) -> Column:
    """Readable text of a bin; ``edges`` and ``levels`` are NULL for the other kind."""
    last = F.size(edges)

    def edge(position: Column) -> Column:
        return short_number(F.get(edges, position - 1))

    numeric = (
        F.when(last == 0, "todos")
        .when(code == 0, F.concat(F.lit("< "), edge(F.lit(1))))
        .when(code == last, F.concat(F.lit(">= "), edge(last)))
        .otherwise(F.concat(F.lit("["), edge(code), F.lit(", "), edge(code + 1), F.lit(")")))
    )
    category = F.when(code < F.size(levels), F.element_at(levels, code + 1)).otherwise(F.lit(SCORECARD_OTHER))
    return (
        F.when(code == SCORECARD_MISSING_CODE, F.lit("faltante"))
        .when(levels.isNotNull(), category)
        .otherwise(numeric)
    )


def fit_bins(
    df: DataFrame,
    target: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    max_bins: int = 10,
    min_share: float = 0.01,
) -> DataFrame:
    """(feature, kind, edges, levels, code, n, share, bad_rate, woe, iv_contribution) for all features."""
    # Written once: four branches read these counts instead of the loans.
    counts = materialize(labelled_counts(df, target, numeric), "bin-counts")
    edges = merge_small_bins(counts, candidate_edges(counts, max_bins), min_share)
    texts = materialize(categorical_counts(df, target, categorical), "level-counts")
    levels = categorical_levels(texts, min_share)
    coded = numeric_codes(counts, edges).unionByName(categorical_codes(texts, levels))
    woe = weight_of_evidence(coded)
    described = woe.join(edges, "feature", "left").join(levels, "feature", "left")
    kind = F.when(F.col("feature").isin(*categorical), "categorical").otherwise("numeric")
    empty = F.array().cast("array<double>")
    return described.select(
        "feature",
        kind.alias("kind"),
        F.when(kind == "numeric", F.coalesce("edges", empty)).alias("edges"),
        F.when(kind == "categorical", F.coalesce("levels", F.array(F.lit(SCORECARD_OTHER)))).alias("levels"),
        "code",
        "n",
        "share",
        "bad_rate",
        "woe",
        "iv_contribution",
    )

"""Reference profiles and drift of all features against them, in long form.

A profile is a typed frame with one row per feature; numeric features carry decile edges,
categorical ones their frequent values, both the share of each bin in the training rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite.config import MISSING, OTHER, MonitoringRules
from underwrite.functions.parsing import dec
from underwrite.functions.scoring import digitize
from underwrite.functions.stats import ks_p_value
from underwrite.operators.preprocessing import long_numeric
from underwrite.operators.quality import category_shares
from underwrite.operators.quantiles import quantiles_of_counts, value_counts
from underwrite.operators.scan import running_total, with_range
from underwrite.session import materialize

SHARE_FLOOR = 1e-6
SCORE = "__score__"
MIN_CATEGORY_SHARE = 0.005


def psi_term(expected: Column, actual: Column) -> Column:
    """One bin's part of the population stability index."""
    e, a = F.greatest(expected, dec(SHARE_FLOOR)), F.greatest(actual, dec(SHARE_FLOOR))
    return (a - e) * F.log(a / e)


def psi(expected: DataFrame, actual: DataFrame, keys: Sequence[str], bin_: str = "bin") -> DataFrame:
    """(keys, psi) of two (keys, bin, share) frames; a bin absent on one side counts as empty."""
    by = [*keys, bin_]
    both = expected.select(*by, F.col("share").alias("_e")).join(
        actual.select(*by, F.col("share").alias("_a")), by, "full_outer"
    )
    term = psi_term(F.coalesce("_e", dec(0)), F.coalesce("_a", dec(0)))
    return both.groupBy(*keys).agg(F.sum(term).alias("psi"))


def feature_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n) with unknown values as NULL: all a profile or a drift table needs.

    Written once, so that bins, facts and distances do not read the rows again.
    """
    long = long_numeric(df, columns)
    value = F.when(~F.isnan("value"), F.col("value")).alias("value")
    return materialize(long.groupBy("feature", value).agg(F.count(F.lit(1)).alias("n")), "feature-counts")


def facts_of_counts(counts: DataFrame) -> DataFrame:
    """(feature, null_rate, mean)."""
    known = F.col("value").isNotNull()
    return counts.groupBy("feature").agg(
        (F.sum(F.when(known, 0).otherwise(F.col("n"))) / F.sum("n").cast("double")).alias("null_rate"),
        F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum(F.when(known, F.col("n")))).alias("mean"),
    )


def numeric_bins(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, bin, share over known values); ``edges`` has one short row per feature."""
    coded = counts.join(F.broadcast(edges.select("feature", "edges")), "feature").groupBy(
        "feature", digitize(F.col("value"), F.col("edges")).alias("bin")
    )
    bins = coded.agg(F.sum("n").alias("n"))
    totals = bins.groupBy("feature").agg(F.sum("n").alias("total"))
    return bins.join(totals, "feature").select("feature", "bin", (F.col("n") / F.col("total").cast("double")).alias("share"))


def numeric_profile(
    df: DataFrame, columns: Sequence[str], bins: int = 10, counts: DataFrame | None = None
) -> DataFrame:
    """(feature, kind, edges, proportions, null_rate, mean); ``counts`` are the rows' feature counts, if at hand."""
    everything = feature_counts(df, columns) if counts is None else counts
    known = everything.filter(F.col("value").isNotNull())
    probs = [i / bins for i in range(1, bins)]
    edges = quantiles_of_counts(known, ["feature"], "value", probs).select(
        "feature", F.array_distinct("q").alias("edges")
    )
    shares = numeric_bins(known, edges).groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "share"))).alias("m")
    )
    facts = facts_of_counts(everything)
    joined = facts.join(edges, "feature", "left").join(shares, "feature", "left")
    cuts = F.coalesce("edges", F.array().cast("array<double>"))
    dense = F.transform(
        F.sequence(F.lit(0), F.size(cuts)), lambda b: F.coalesce(F.try_element_at(F.col("m"), b), dec(0))
    )
    return joined.select(
        "feature", F.lit("numeric").alias("kind"), cuts.alias("edges"), dense.alias("proportions"), "null_rate", "mean"
    )


def categorical_profile(df: DataFrame, columns: Sequence[str], min_share: float = MIN_CATEGORY_SHARE) -> DataFrame:
    """(feature, kind, categories, proportions, null_rate); the last proportion is the catch-all."""
    shares = category_shares(df, list(columns), MISSING)
    frequent = F.col("share") >= min_share
    # At most 1 / min_share categories are frequent, so the gathered arrays are bounded.
    grouped = shares.groupBy("feature").agg(
        F.sort_array(F.collect_list(F.when(frequent, F.struct("value", "share")))).alias("kept"),
        F.coalesce(F.sum(F.when(~frequent, F.col("share"))), dec(0)).alias("rest"),
        F.coalesce(F.max(F.when(F.col("value") == MISSING, F.col("share"))), dec(0)).alias("null_rate"),
    )
    return grouped.select(
        "feature",
        F.lit("categorical").alias("kind"),
        F.col("kept.value").alias("categories"),
        F.concat(F.col("kept.share"), F.array("rest")).alias("proportions"),
        "null_rate",
    )


def reference_profile(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    score: str | None = None,
    bins: int = 10,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Profile of the training rows, the score included under its reserved name; ``counts`` from :func:`profile_counts`."""
    frame = df.withColumn(SCORE, F.col(score)) if score else df
    names = [*numeric, SCORE] if score else list(numeric)
    return numeric_profile(frame, names, bins, counts).unionByName(
        categorical_profile(frame, categorical), allowMissingColumns=True
    )


def profile_counts(df: DataFrame, columns: Sequence[str], score: str | None = None) -> DataFrame:
    """(feature, value, n) of all training rows, the score included: stored with the profile, current rows are
    compared with every one of them."""
    frame = df.withColumn(SCORE, F.col(score)) if score else df
    names = [*columns, SCORE] if score else list(columns)
    return feature_counts(frame, names)


def two_sample_ks(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, ks_statistic, n1, n2): largest gap of the two cumulative distributions."""
    return ks_of_counts(value_counts(left, keys, value), value_counts(right, keys, value), keys, value)


def ks_of_counts(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The same from (keys, value, n) counts without unknown values."""
    zero = F.lit(0).cast("bigint")
    a = left.select(*keys, F.col(value).alias("score"), F.col("n").alias("a"), zero.alias("b"))
    b = right.select(*keys, F.col(value).alias("score"), zero.alias("a"), F.col("n").alias("b"))
    counts = a.unionByName(b).groupBy(*keys, "score").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    walked = running_total(
        with_range(counts, ["score"], grouped=True),
        keys,
        ["score"],
        {"ca": F.col("a"), "cb": F.col("b")},
        {"ca": "na", "cb": "nb"},
    )
    gap = F.try_divide(F.col("ca"), F.col("na").cast("double")) - F.try_divide(F.col("cb"), F.col("nb").cast("double"))
    return walked.groupBy(*keys).agg(
        F.max(F.abs(gap)).alias("ks_statistic"), F.max("na").alias("n1"), F.max("nb").alias("n2")
    )


def drift_status(value: Column, rules: MonitoringRules) -> Column:
    return (
        F.when(value >= rules.psi_alert, "alerta").when(value >= rules.psi_warning, "warning").otherwise("estable")
    )


def profile_bins(profile: DataFrame) -> DataFrame:
    """(feature, bin, share): numeric bins by number, categorical bins by value."""
    listed = profile.select("feature", "kind", "categories", F.posexplode("proportions").alias("pos", "share"))
    label = F.coalesce(F.get("categories", F.col("pos")), F.lit(OTHER))
    return listed.select(
        "feature", F.when(F.col("kind") == "numeric", F.col("pos").cast("string")).otherwise(label).alias("bin"), "share"
    )


def feature_drift(
    profile: DataFrame,
    reference: DataFrame,
    current: DataFrame,
    score: str | None = None,
    rules: MonitoringRules | None = None,
) -> DataFrame:
    """One row per profiled feature the current rows have: PSI, KS, null rates, means, status.

    ``reference`` holds the (feature, value, n) counts of :func:`profile_counts`.
    """
    rules = rules or MonitoringRules()
    frame = current.withColumn(SCORE, F.col(score)) if score else current
    # The profile has one row per feature; its names decide which columns to unpivot.
    kinds = {r["feature"]: r["kind"] for r in profile.select("feature", "kind").collect()}
    numeric = [f for f, kind in kinds.items() if kind == "numeric" and f in frame.columns]
    texts = [f for f, kind in kinds.items() if kind != "numeric" and f in frame.columns]

    everything = feature_counts(frame, numeric)
    counts = everything.filter(F.col("value").isNotNull())
    now = numeric_bins(counts, profile.filter("kind = 'numeric'")).withColumn("bin", F.col("bin").cast("string"))
    facts = facts_of_counts(everything).select(
        "feature", F.col("null_rate").alias("null_rate_cur"), F.col("mean").alias("mean_cur")
    )
    if texts:
        shares = category_shares(frame, texts, MISSING)
        known = profile_bins(profile.filter("kind = 'categorical'")).select("feature", F.col("bin").alias("value"), F.lit(True).alias("_known"))
        mapped = shares.join(F.broadcast(known), ["feature", "value"], "left").groupBy(
            "feature", F.when(F.col("_known"), F.col("value")).otherwise(F.lit(OTHER)).alias("bin")
        )
        now = now.unionByName(mapped.agg(F.sum("share").alias("share")))
        empties = shares.groupBy("feature").agg(
            F.coalesce(F.max(F.when(F.col("value") == MISSING, F.col("share"))), dec(0)).alias("null_rate_cur")
        )
        facts = facts.unionByName(empties, allowMissingColumns=True)
    stability = psi(profile_bins(profile), now, ["feature"])
    before = reference.filter(F.col("value").isNotNull())
    distance = ks_of_counts(before, counts, ["feature"], "value").filter((F.col("n1") > 0) & (F.col("n2") > 0))
    p = ks_p_value("ks_statistic", "n1", "n2")
    joined = (
        profile.select("feature", "kind", F.col("null_rate").alias("null_rate_ref"), F.col("mean").alias("mean_ref"))
        .join(facts, "feature")
        .join(stability, "feature")
        .join(distance.select("feature", "ks_statistic", p.alias("ks_pvalue")), "feature", "left")
    )
    return joined.select(
        F.when(F.col("feature") == SCORE, "prediction").otherwise(F.col("feature")).alias("feature"),
        "kind",
        "psi",
        "ks_statistic",
        "ks_pvalue",
        F.coalesce(F.col("ks_pvalue") < rules.ks_pvalue_alert, F.lit(False)).alias("ks_drift"),
        "null_rate_ref",
        "null_rate_cur",
        "mean_ref",
        "mean_cur",
        drift_status(F.col("psi"), rules).alias("status"),
    )


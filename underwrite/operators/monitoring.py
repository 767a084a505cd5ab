"""Delayed labels, concept drift and the retraining decision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite.config import MonitoringRules
from underwrite.functions.parsing import dec
from underwrite.functions.scoring import clip, log_loss, misclassified
from underwrite.functions.stats import two_proportion_z, two_sided_p
from underwrite.operators.detectors import ddm, page_hinkley
from underwrite.operators.metrics import classification_report
from underwrite.operators.small import join_keys

SIGNALS = (
    "auc_degradation",
    "ks_degradation",
    "calibration_degradation",
    "ddm_drift",
    "page_hinkley_drift",
    "prior_shift",
)


def visible_labels(log: DataFrame, outcomes: DataFrame, clock: Column, log_filter: Column | None = None) -> DataFrame:
    """Scored requests with the outcomes already observed at the clock.

    Both sides are filtered before the equi-join on the request id.
    """
    left = log if log_filter is None else log.filter(log_filter)
    seen = outcomes.filter(F.col("observed_ts") <= clock).select("request_id", "actual_default", "observed_ts")
    return left.join(seen, "request_id")


def latest_row(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Newest row per key as a maximum over structs (combines before the shuffle)."""
    rest = [c for c in df.columns if c not in keys and c != by]
    newest = F.max(F.struct(by, *rest)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def concept_report(
    labelled: DataFrame,
    label: str,
    score: str,
    order: Sequence[Column | str],
    reference: Mapping[str, float],
    threshold: float = 0.5,
    rules: MonitoringRules | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per key: current metrics, drops against the reference, detector states, signals.

    ``reference`` needs roc_auc, ks, brier and default_rate_observed of the training report.
    """
    rules = rules or MonitoringRules()
    p = clip(score, 1e-7, 1 - 1e-7)
    rows = labelled.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    report = classification_report(rows, label, score, threshold, keys)
    warned = ddm(rows, misclassified(label, p, threshold), order, keys, rules).select(
        *keys, F.col("state").alias("ddm_state"), F.col("index").alias("ddm_index")
    )
    climbed = page_hinkley(rows, log_loss(label, p), order, keys, rules).select(
        *keys, F.col("drift").alias("page_hinkley_drift"), F.col("statistic").alias("page_hinkley_statistic")
    )
    by = list(keys)
    if not by:
        one = F.lit(1).alias("_k")
        report, warned, climbed = (d.select(one, "*") for d in (report, warned, climbed))
        by = ["_k"]
    joined = join_keys(join_keys(report, warned, by), climbed, by)

    base = reference["default_rate_observed"]
    z = two_proportion_z(
        F.col("n_pos"), F.col("n"), F.lit(int(round(base * rules.reference_n))), F.lit(rules.reference_n)
    )
    measured = joined.withColumns(
        {
            "auc_drop": dec(reference["roc_auc"]) - F.col("roc_auc"),
            "ks_drop": dec(reference["ks"]) - F.col("ks"),
            "brier_increase": F.col("brier") - dec(reference["brier"]),
            "calibration_gap": F.col("default_rate_predicted") - F.col("default_rate_observed"),
            "prior_shift_z": z,
        }
    ).withColumn("prior_shift_p", two_sided_p("prior_shift_z"))
    shifted = F.abs(F.col("default_rate_observed") - dec(base)) >= rules.default_rate_abs_change
    flags = {
        "auc_degradation": F.col("auc_drop") >= rules.auc_drop_alert,
        "ks_degradation": F.col("ks_drop") >= rules.ks_drop_alert,
        "calibration_degradation": F.col("brier_increase") >= rules.brier_increase_alert,
        "ddm_drift": F.col("ddm_state") == "drift",
        "page_hinkley_drift": F.col("page_hinkley_drift"),
        "prior_shift": shifted & (F.col("prior_shift_p") < 0.05),
    }
    flags = {n: F.coalesce(c, F.lit(False)) for n, c in flags.items()}
    flagged = measured.withColumns(flags)
    drifted = F.col("auc_degradation") | F.col("ks_degradation") | (F.col("ddm_drift") & F.col("page_hinkley_drift"))
    return flagged.withColumn("concept_drift", drifted).drop("_k")


def drift_summary(drift: DataFrame, keys: Sequence[str] = (), rules: MonitoringRules | None = None) -> DataFrame:
    """(keys, drifted, prediction_psi) of a drift table; names in alphabetical order."""
    rules = rules or MonitoringRules()
    feature, value = F.col("feature"), F.col("psi")
    hit = (feature != "prediction") & (value >= rules.psi_alert)
    return drift.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.when(hit, feature))).alias("drifted"),
        F.max(F.when(feature == "prediction", value)).alias("prediction_psi"),
    )


def retrain_decision(
    n_rows: Column,
    drifted: Column,
    prediction_psi: Column,
    fired: Column,
    concept_drift: Column,
    last_retrain: Column,
    now: Column,
    rules: MonitoringRules | None = None,
) -> Column:
    """Struct (retrain, reasons, severity) from aggregates.

    ``fired`` is an array of signal names. Inside the cooldown the flag is suppressed, the reasons
    stay and say so.
    """
    rules = rules or MonitoringRules()
    count = F.size(drifted)
    features = F.when(
        count >= rules.max_features_drifted,
        F.concat(F.lit("data drift en "), count.cast("string"), F.lit(" features: "), F.array_join(drifted, ", ")),
    )
    prediction = F.when(
        prediction_psi >= rules.prediction_psi_alert, F.format_string("prediction drift PSI=%.3f", prediction_psi)
    )
    concept = F.transform(fired, lambda s: F.concat(F.lit("concept drift: "), s))
    reasons = F.concat(F.array_compact(F.array(features, prediction)), F.coalesce(concept, F.array().cast("array<string>")))
    wanted = F.size(reasons) > 0
    days = 30 * rules.retrain_cooldown_months
    cooling = wanted & F.coalesce(now < last_retrain + F.make_dt_interval(F.lit(days)), F.lit(False))
    note = F.array(F.lit("cooldown activo: se registra la alerta pero no se reentrena"))
    thin = n_rows < rules.min_rows
    thin_reason = F.array(
        F.concat(F.lit("ventana con "), n_rows.cast("string"), F.lit(f" filas < {rules.min_rows}"))
    )
    severity = (
        F.when(thin, "sin_datos")
        .when(F.coalesce(concept_drift, F.lit(False)), "critico")
        .when(wanted, "alerta")
        .otherwise("estable")
    )
    return F.struct(
        (~thin & wanted & ~cooling).alias("retrain"),
        F.when(thin, thin_reason).when(cooling, F.concat(reasons, note)).otherwise(reasons).alias("reasons"),
        severity.alias("severity"),
    )


def fired_signals(report_columns: Sequence[str] = SIGNALS) -> Column:
    """Names of the raised flags of a concept report, in their fixed order."""
    return F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in report_columns]))


def monitoring_kpis(monitoring: DataFrame, experiments: DataFrame) -> DataFrame:
    """Latest monitoring month next to the latest experiment verdict (one row)."""
    last = monitoring.agg(
        *[
            F.max_by(c, F.struct("clock_month", "run_ts")).alias(c)
            for c in (
                "clock_month",
                "severity",
                "roc_auc",
                "prediction_psi",
                "default_rate_observed",
                "default_rate_predicted",
                "features_drifted",
            )
        ]
    )
    verdict = experiments.agg(F.max_by(F.struct("decision", "reason"), "run_ts").alias("v")).scalar()
    return last.withColumn("_v", verdict).select(
        *last.columns, F.col("_v.decision").alias("ab_decision"), F.col("_v.reason").alias("ab_reason")
    )

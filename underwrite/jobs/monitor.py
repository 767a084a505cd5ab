"""Monitoring job: drift of the logged inputs, concept drift of the labelled ones, and the retraining decision.

All dates follow the clock of the log (its last replayed month). One run appends the drift of every feature, one row of
20 columns and, if it says so, a retraining event; a repeated run of the same id adds nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite.config import MonitoringRules, ReplayRules
from underwrite.functions.calendar import monitoring_windows
from underwrite.jobs.profiles import newest_profile
from underwrite.operators.drift import feature_drift
from underwrite.operators.monitoring import SIGNALS, concept_report, drift_summary, fired_signals, retrain_decision, visible_labels
from underwrite.session import materialize
from underwrite.sources.store import OperationalStore

#: What a run takes from the concept report, NULL where there is none.
CONCEPT = {
    "roc_auc": "double", "ks": "double", "brier": "double", "auc_drop": "double", "default_rate_observed": "double",
    "default_rate_predicted": "double", "ddm_state": "string", "page_hinkley_statistic": "double", "concept_drift": "boolean",
    "fired": "array<string>",
}


def request_order(request_id: Column | str = "request_id") -> Column:
    """A number that orders requests of the same time: the first 60 bits of the id's hexadecimal digest."""
    column = F.col(request_id) if isinstance(request_id, str) else request_id
    return F.conv(F.substring(column, 1, 15), 16, 10).cast("bigint")


def concept_facts(
    labelled: DataFrame, reference: Mapping[str, float], threshold: float, rules: MonitoringRules
) -> DataFrame:
    """One row: n_labeled and the columns of ``CONCEPT``, known only with enough labelled rows of both classes."""
    report = concept_report(labelled, "actual_default", "probability", ["event_ts", request_order()], reference, threshold, rules)
    report = report.withColumn("fired", fired_signals(SIGNALS))
    size = labelled.agg(F.count(F.lit(1)).alias("n_labeled"), F.count_if(F.col("actual_default") == 1).alias("_bad"), F.count_if(F.col("actual_default") == 0).alias("_good"))
    enough = (F.col("n_labeled") >= rules.min_rows) & (F.col("_bad") > 0) & (F.col("_good") > 0)
    facts = [F.when(enough, F.col(n)).cast(kind).alias(n) for n, kind in CONCEPT.items()]
    one = F.lit(1).alias("_one")
    return size.select(one, "*").join(report.select(one, *CONCEPT), "_one", "left").select("n_labeled", *facts)


def run_monitoring(
    store: OperationalStore,
    run: str,
    run_ts: str,
    version: str,
    threshold: float = 0.5,
    rules: MonitoringRules | None = None,
    replay: ReplayRules | None = None,
) -> bool:
    """Monitor one model version at the clock of its log; False without traffic or a profile, or if the run was committed before."""
    rules, replay = rules or MonitoringRules(), replay or ReplayRules()
    if store.committed(run):
        return False
    log = store.read("inference_log").where("source = 'replay'")
    clock = log.agg(F.max("event_ts")).first()[0]
    stored = newest_profile(store, version)
    if clock is None or stored is None:
        return False
    bounds = monitoring_windows(F.lit(clock), rules.window_months, replay.label_delay_months)
    served = log.where((F.col("variant") == "champion") & (F.col("model_version") == version)).withColumn("_w", bounds)
    recent = served.where(F.col("event_ts").between(F.col("_w.drift_start"), F.col("_w.drift_end"))).drop("_w")
    drift = materialize(feature_drift(stored.profile, stored.counts, recent, "probability", rules), "monitor-drift")
    labelled = visible_labels(
        served.where(F.col("event_ts").between(F.col("_w.label_start"), F.col("_w.label_end"))).drop("_w"), store.read("outcomes"), F.lit(clock)
    )
    stamped = {"run_id": F.lit(run), "run_ts": F.lit(run_ts).cast("timestamp"), "clock_month": F.lit(clock), "model_version": F.lit(version)}

    last = store.read("retrain_events").agg(F.max("clock_month").alias("last"))
    size = recent.agg(F.count(F.lit(1)).alias("n_rows"))
    one = F.lit(1).alias("_one")
    facts = size.select(one, "*")
    for part in (drift_summary(drift, (), rules), concept_facts(labelled, stored.metrics, threshold, rules), last):
        facts = facts.join(part.select(one, "*"), "_one")
    decision = retrain_decision(
        F.col("n_rows"), F.col("drifted"), F.col("prediction_psi"), F.coalesce("fired", F.array().cast("array<string>")), F.col("concept_drift"),
        F.col("last"), F.col("clock_month"), rules,
    )
    enough = F.col("n_rows") >= rules.min_rows
    row = facts.withColumns(stamped).withColumn("_d", decision).select(
        *stamped, "n_rows", "n_labeled", F.when(enough, F.size("drifted")).otherwise(0).alias("features_drifted"), "prediction_psi",
        *[n for n in CONCEPT if n not in ("concept_drift", "fired")], F.coalesce("concept_drift", F.lit(False)).alias("concept_drift"),
        "_d.severity", "_d.retrain", F.to_json("_d.reasons").alias("reasons"),
    )
    row = materialize(row, "monitor-row")
    event = row.where("retrain").select(F.col("run_ts").alias("event_ts"), "clock_month", F.lit("monitoring").alias("trigger"), "reasons", "model_version")
    return store.append(run, {"drift_by_feature": drift.withColumns(stamped), "monitoring_metrics": row, "retrain_events": event})

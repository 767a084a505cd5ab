"""Incremental monthly scoring of new originations with delayed outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite.config import CreditPolicy, ExperimentRules, LoanSpec, ReplayRules
from underwrite.functions.calendar import month_start, months_to_process, plus_months
from underwrite.functions.decisions import assign_variant, decide, fingerprint, served_variant
from underwrite.functions.scoring import risk_band


def high_water_mark(log: DataFrame, source: str = "replay") -> Column:
    """Scalar subquery: the last month already scored."""
    return log.filter(F.col("source") == source).agg(F.max("event_ts").alias("m")).scalar()


def pending_rows(
    features: DataFrame, log: DataFrame, spec: LoanSpec | None = None, rules: ReplayRules | None = None
) -> DataFrame:
    """Rows of the next months after the high-water mark; all months in one plan."""
    spec, rules = spec or LoanSpec(), rules or ReplayRules()
    end = F.to_timestamp(F.lit(rules.production_end))
    start = F.to_timestamp(F.lit(rules.production_start))
    available = features.agg(F.max(spec.date_column).alias("m")).scalar()
    marks = features.withColumn("_last", high_water_mark(log)).withColumn("_available", available)
    months = months_to_process(
        F.col("_last").cast("timestamp"),
        start,
        rules.months_per_run,
        F.least(F.col("_available").cast("timestamp"), end),
    )
    month = month_start(spec.date_column).cast("timestamp")
    return marks.filter(F.array_contains(months, month)).drop("_last", "_available")


def score_months(
    pending: DataFrame,
    p_champion: Column,
    p_challenger: Column | None,
    threshold: float,
    spec: LoanSpec | None = None,
    rules: ReplayRules | None = None,
    experiment: ExperimentRules | None = None,
    policy: CreditPolicy | None = None,
    versions: tuple[str, str] = ("1", "2"),
) -> DataFrame:
    """Inference-log rows of the pending months: variant, probability, decision, fingerprint.

    Every pending row is scored. The request id is a digest of loan and month, so a repeated
    run writes the same ids.
    """
    spec, rules = spec or LoanSpec(), rules or ReplayRules()
    experiment, policy = experiment or ExperimentRules(), policy or CreditPolicy()
    traffic = experiment.challenger_traffic if p_challenger is not None else 0.0
    assigned = assign_variant(spec.id_column, traffic, experiment.salt)
    challenger = p_challenger if p_challenger is not None else F.lit(None).cast("double")
    served = pending.withColumn("_s", served_variant(assigned, p_champion, challenger)).select(
        *pending.columns, F.col("_s.variant").alias("variant"), F.col("_s.probability").alias("probability")
    )
    decided = served.withColumn(
        "_d", decide("probability", F.lit(float(threshold)), "annual_inc", "installment", "dti", policy=policy)
    )
    month = month_start(spec.date_column).cast("timestamp")
    version = F.when(F.col("variant") == "challenger", versions[1]).otherwise(versions[0])
    return decided.select(
        F.sha2(F.concat_ws(":", F.lit("replay"), F.col(spec.id_column), F.unix_date(month.cast("date")).cast("string")), 256).alias(
            "request_id"
        ),
        spec.id_column,
        month.alias("event_ts"),
        F.lit("replay").alias("source"),
        "variant",
        version.alias("model_version"),
        "probability",
        F.col("_d.decision").alias("decision"),
        risk_band("probability").alias("risk_band"),
        F.lit(None).cast("double").alias("latency_ms"),
        F.col("_d.policy_version").alias("policy_version"),
        F.to_json("_d.reasons").alias("reasons"),
        fingerprint(spec.inputs).alias("input_hash"),
        *spec.inputs,
        spec.target,
    )


def delayed_outcomes(scored: DataFrame, target: str, id_column: str, delay_months: int = 6) -> DataFrame:
    """Outcome rows that become visible ``delay_months`` after origination; labelled rows only."""
    return scored.filter(F.col(target).isNotNull()).select(
        id_column,
        "request_id",
        F.col(target).cast("int").alias("actual_default"),
        plus_months("event_ts", delay_months).alias("observed_ts"),
        F.lit("replay").alias("source"),
    )

"""Champion against challenger on labelled traffic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite.config import APPROVE, ExperimentRules
from underwrite.functions.stats import two_proportion_z, two_sided_p
from underwrite.operators.bootstrap import auc_difference
from underwrite.operators.delong import auc_interval

CHAMPION, CHALLENGER = "champion", "challenger"


def comparable_population(
    log: DataFrame, outcomes: DataFrame, clock: Column, versions: Mapping[str, str]
) -> DataFrame:
    """Labelled requests of both arms since the challenger served its first one.

    ``versions`` names the model version of each arm: requests that another version answered are left out, and
    an earlier challenger does not move the start.
    """
    fixed = F.create_map(*[F.lit(x) for pair in versions.items() for x in pair])
    log = log.filter(F.col("model_version") == F.try_element_at(fixed, F.col("variant")))
    started = log.filter(F.col("variant") == CHALLENGER).agg(F.min("event_ts").alias("m")).scalar()
    seen = outcomes.filter(F.col("observed_ts") <= clock).select("request_id", "actual_default")
    scored = log.filter(F.col("probability").isNotNull() & F.col("variant").isin(CHAMPION, CHALLENGER))
    in_time = scored.withColumn("_s", started).filter(F.col("_s").isNull() | (F.col("event_ts") >= F.col("_s")))
    return in_time.drop("_s").join(seen, "request_id")


def arm_summary(
    df: DataFrame, variant: str = "variant", label: str = "actual_default", decision: str = "decision",
    keys: Sequence[str] = (),
) -> DataFrame:
    """(keys, variant, n, approved, approval_rate, bad_approved, bad_rate_approved)."""
    ok = F.col(decision) == APPROVE
    bad = F.sum(F.when(ok, F.col(label)).otherwise(0))
    approved = F.sum(ok.cast("bigint"))
    return df.groupBy(*keys, variant).agg(
        F.count(F.lit(1)).alias("n"),
        approved.alias("approved"),
        F.avg(ok.cast("double")).alias("approval_rate"),
        bad.alias("bad_approved"),
        (bad / F.greatest(approved, F.lit(1)).cast("double")).alias("bad_rate_approved"),
    )


def side_by_side(arms: DataFrame, columns: Sequence[str], variant: str = "variant", keys: Sequence[str] = ()) -> DataFrame:
    """One row per key with a column per arm."""
    picks = [
        F.max(F.when(F.col(variant) == arm, F.col(c))).alias(f"{c}_{arm}")
        for c in columns
        for arm in (CHAMPION, CHALLENGER)
    ]
    return arms.groupBy(*keys).agg(*picks)


def verdict(
    n_champion: Column,
    n_challenger: Column,
    ci_low: Column,
    ci_high: Column,
    p_value: Column,
    bad_rate_z: Column,
    bad_rate_p: Column,
    months_running: Column,
    rules: ExperimentRules | None = None,
) -> Column:
    """Struct (decision, reason)."""
    rules = rules or ExperimentRules()

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    few = F.coalesce(F.least(n_champion, n_challenger), F.lit(0)) < rules.min_labeled_per_arm
    few = few | n_champion.isNull() | n_challenger.isNull()
    better = sure((ci_low > 0) & (p_value < rules.alpha))
    harm = sure((bad_rate_p < rules.alpha) & (bad_rate_z > 0))
    worse = sure(ci_high < 0)
    over = sure(months_running >= rules.max_test_months)
    decision = (
        F.when(few, "continuar").when(better & ~harm, "promover").when(worse | harm | over, "detener").otherwise("continuar")
    )
    reason = (
        F.when(few, "muestra insuficiente por brazo")
        .when(better & ~harm, "challenger superior con significancia")
        .when(worse | harm, "challenger inferior o dañino para el negocio")
        .when(over, "sin diferencia significativa al cierre del test")
        .otherwise("aún sin significancia")
    )
    return F.struct(decision.alias("decision"), reason.alias("reason"))


def evaluate(
    population: DataFrame, months_running: Column, rules: ExperimentRules | None = None, iterations: int | None = None
) -> DataFrame:
    """The full experiment row: arms, AUCs with bootstrap difference, bad-rate test, verdict."""
    rules = rules or ExperimentRules()
    arms = side_by_side(arm_summary(population), ["n", "approved", "approval_rate", "bad_approved", "bad_rate_approved"])
    aucs = side_by_side(auc_interval(population, "actual_default", "probability", ["variant"]), ["auc"])
    n = iterations or rules.bootstrap_iterations
    gain = auc_difference(population, "actual_default", "probability", "variant", CHAMPION, CHALLENGER, n)
    one = F.lit(1).alias("_k")
    joined = (
        arms.select(one, "*").join(aucs.select(one, "*"), "_k").join(gain.select(one, "*"), "_k", "left").drop("_k")
    )
    z = two_proportion_z("bad_approved_challenger", "approved_challenger", "bad_approved_champion", "approved_champion")
    tested = joined.withColumn("bad_rate_z", z).withColumn("bad_rate_pvalue", two_sided_p("bad_rate_z"))
    tested = tested.withColumn("months_running", months_running)
    outcome = verdict(
        *[
            F.col(c)
            for c in (
                "n_champion",
                "n_challenger",
                "ci_low",
                "ci_high",
                "p_value",
                "bad_rate_z",
                "bad_rate_pvalue",
                "months_running",
            )
        ],
        rules,
    )
    return tested.withColumn("_v", outcome).select("_v.*", *tested.columns)

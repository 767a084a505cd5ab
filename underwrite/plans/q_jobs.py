"""Jobs end to end: stored profiles, monthly replay and monitoring over committed runs, read back from the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underwrite import config as C
from underwrite.jobs.monitor import run_monitoring
from underwrite.jobs.profiles import newest_profile, save_profile
from underwrite.jobs.replay import Arms, run_replay
from underwrite.operators.drift import profile_bins
from underwrite.plans import oracles as O
from underwrite.plans.q_loans import CATS, SPEC, day, features, written_features
from underwrite.plans.q_risk import CONCEPT_CTES, DECILES, KS_P, KS_SQL, PRIOR_Z, PSI, REFERENCE
from underwrite.plans.registry import register, rounded
from underwrite.session import scratch_path
from underwrite.sources.store import OperationalStore

NUMS = SPEC.numeric_names
START, END = "1997-01-01", "1999-06-01"


def arms() -> Arms:
    return Arms(F.col("dti") / 300, F.col("fico_score") / 2000, threshold=0.18)


def new_store(spark: SparkSession) -> OperationalStore:
    return OperationalStore(spark, scratch_path(spark, "store"))


def replayed(rows: DataFrame, store: OperationalStore, *steps: tuple[str, int]) -> OperationalStore:
    """Run the replay job on a feature table once per (run id, months)."""
    for run, months in steps:
        run_replay(store, run, rows, arms(), SPEC, C.ReplayRules(production_start=START, production_end=END, months_per_run=months))
    return store


def replay_sql(months: int) -> str:
    """CTEs ``sc`` (scored months) and ``rj`` (with the knock-outs) for the first ``months`` months of production."""
    return (
        f"{O.features()}, sc as (select *, case when ch then fico_score / 2000 else dti / 300 end as p from (select *, {O.bucket('loan_id')} < 0.2 as ch "
        f"from features where issue_month >= timestamp '{START}' and issue_month < timestamp '{START}' + interval {months} month)), "
        "rj as (select *, (annual_inc > 0 and coalesce(installment, 0) / (annual_inc / 12) > 0.4) or dti > 45 as ko from sc)"
    )


# --- P5, P6: two runs and a repeated one ---------------------------------------------------------
TWO_RUNS = (("replay-1", 3), ("replay-2", 3), ("replay-2", 3))


@register(
    "p05_monthly_replay",
    f"with {replay_sql(6)} select loan_id, cast(cast(issue_month as date) as varchar) as month, case when ch then 'challenger' else 'champion' end as variant, case when ch then '2' else '1' end as model_version, p as probability, "
    f"case when p is null then 'REVISION_MANUAL' when coalesce(ko, false) or p >= 0.18 then 'RECHAZAR' when p >= 0.18::double - 0.02::double then 'REVISION_MANUAL' else 'APROBAR' end as decision, {O.band('p')} as risk_band, "
    "sha256('replay:' || loan_id || ':' || date_diff('day', date '1970-01-01', cast(issue_month as date))) as request_id, fico_score, grade from rj",
)
def monthly_replay(spark, sf):
    """The log after two runs of three months and a repetition of the second, which adds nothing."""
    rows = replayed(features(spark, sf), new_store(spark), *TWO_RUNS).read("inference_log")
    return rounded(
        rows.select("loan_id", day("event_ts").alias("month"), "variant", "model_version", "probability", "decision", "risk_band", "request_id", "fico_score", "grade")
    )


@register(
    "p06_delayed_outcomes",
    f"with {replay_sql(6)} select loan_id, cast(target_default as int) as actual_default, cast(cast(issue_month + interval 6 month as date) as varchar) as observed from rj where target_default is not null",
)
def delayed_outcomes(spark, sf):
    rows = replayed(features(spark, sf), new_store(spark), *TWO_RUNS).read("outcomes")
    return rows.select("loan_id", "actual_default", day("observed_ts").alias("observed"))


@register(
    "p05_replay_runs",
    f"with {replay_sql(6)}, m as (select *, case when issue_month < timestamp '{START}' + interval 3 month then 'replay-1' else 'replay-2' end as run from sc) "
    "select run, count(*) as n_log, count(target_default) as n_outcomes, cast(cast(max(issue_month) as date) as varchar) as clock from m group by run",
)
def replay_runs(spark, sf):
    """What each committed run added."""
    store = replayed(features(spark, sf), new_store(spark), *TWO_RUNS)
    out = None
    for run in ("replay-1", "replay-2"):
        log = store.read("inference_log", run).agg(F.count(F.lit(1)).alias("n_log"), F.max("event_ts").alias("clock"))
        late = store.read("outcomes", run).agg(F.count(F.lit(1)).alias("n_outcomes"))
        one = log.crossJoin(late).select(F.lit(run).alias("run"), "n_log", "n_outcomes", day("clock").alias("clock"))
        out = one if out is None else out.unionByName(one)
    return out


# --- C5, D9: versioned profiles ------------------------------------------------------------------
TRAIN = "issue_month >= timestamp '1996-01-01' and issue_month < timestamp '1997-01-01'"
EARLIER = "issue_month < timestamp '1996-01-01'"


def profiled(rows: DataFrame, store: OperationalStore, *runs: tuple[str, str, str]) -> OperationalStore:
    """Profile version 1 once per (run id, time of creation, condition on the feature table)."""
    scored = rows.withColumn("_score", F.col("dti") / 300)
    for run, at, condition in runs:
        save_profile(store, run, "1", at, scored.where(condition), NUMS, CATS, "_score", REFERENCE)
    return store


def long_sql(source: str) -> str:
    """(feature, value) of all numeric inputs and the score, unknown values included."""
    return " union all ".join(f"select '{c}' as feature, {c}::double as value from {source}" for c in [*NUMS, "__score__"])


def cats_sql(source: str) -> str:
    """(feature, bin, share) of all categories."""
    parts = [f"select '{c}' as feature, coalesce({c}, '__missing__') as value, count(*) * 1.0 / (select count(*) from {source}) as share from {source} group by 2" for c in CATS]
    return " union all ".join(parts)


#: Profile of ``tr`` in CTEs: bins of numbers (``os``), kept categories (``co``), facts.
PROFILE_SQL = (
    f"ol as ({long_sql('tr')}), o as (select * from ol where value is not null), "
    f"ed as (select feature, list_sort(list_distinct(quantile_cont(value, {DECILES}))) as edges from o group by 1), "
    "ob as (select o.feature, len(list_filter(edges, lambda e: e <= value)) as bin, count(*) as n from o join ed on o.feature = ed.feature group by all), "
    "os as (select feature, cast(bin as varchar) as bin, n / sum(n) over (partition by feature) as share from ob), "
    f"ca as ({cats_sql('tr')}), co as (select feature, case when share >= 0.005 then value else '__other__' end as bin, sum(share) as share from ca group by all), "
    "fo as (select feature, avg((value is null)::int) as null_rate, avg(value) as mean from ol group by 1 "
    "union all select feature, coalesce(max(share) filter (where value = '__missing__'), 0), null from ca group by 1)"
)


@register(
    "c05_newest_profile",
    f"with {O.features()}, tr as (select *, dti / 300 as __score__ from features where {TRAIN}), {PROFILE_SQL} "
    "select e.feature, e.bin, share, null_rate, mean, 0.75e0 as roc_auc, 0.2e0 as default_rate_observed, n_values::bigint as n_values, n_rows::bigint as n_rows "
    "from (select * from os union all select * from co where share > 0) e join fo using (feature) "
    "left join (select feature, count(distinct value) as n_values, count(value) as n_rows from ol group by 1) using (feature)",
)
def newest_stored_profile(spark, sf):
    """Bins, facts, training metrics and value counts of the newest profile of version 1, read back."""
    store = profiled(features(spark, sf), new_store(spark), ("profile-b", "1997-01-05", TRAIN), ("profile-a", "1996-01-05", EARLIER))
    newest = newest_profile(store, "1")
    facts = newest.profile.select("feature", "null_rate", "mean")
    known = newest.counts.where("value is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_rows"))
    bins = profile_bins(newest.profile).where("share > 0").join(facts, "feature").join(known, "feature", "left")
    metrics = [F.lit(newest.metrics[n]).alias(n) for n in ("roc_auc", "default_rate_observed")]
    return rounded(bins.select("*", *metrics))


# --- P10: two months of monitoring and a repeated run --------------------------------------------
RULES = C.MonitoringRules(min_rows=20)
MONTHS = 8


def monitored(spark: SparkSession, sf: str) -> OperationalStore:
    """Eight months of replay, a monitoring run, one month more, a second monitoring run and its repetition."""
    rows = written_features(spark, sf)
    store = profiled(rows, new_store(spark), ("profile", "1997-01-05", TRAIN))
    replayed(rows, store, ("replay-1", MONTHS))
    run_monitoring(store, "monitor-1", "1997-09-03 06:00:00", "1", 0.18, RULES)
    replayed(rows, store, ("replay-2", 1))
    for _ in range(2):
        run_monitoring(store, "monitor-2", "1997-10-03 06:00:00", "1", 0.18, RULES)
    return store


def drift_sql(months: int) -> str:
    """CTEs up to ``drift``: the champion's logged inputs of the last three months against the stored profile."""
    clock = f"timestamp '{START}' + interval {months - 1} month"
    return (
        f"{replay_sql(months)}, lg as (select *, p as __score__, ('0x' || substr(sha256('replay:' || loan_id || ':' || date_diff('day', date '1970-01-01', cast(issue_month as date))), 1, 15))::bigint as request_order from sc where not ch), "
        f"tr as (select *, dti / 300 as __score__ from features where {TRAIN}), rc as (select * from lg where issue_month >= {clock} - interval 2 month), "
        f"{PROFILE_SQL}, nl as ({long_sql('rc')}), n as (select * from nl where value is not null), {KS_SQL}, "
        "nb as (select n.feature, cast(len(list_filter(edges, lambda e: e <= value)) as varchar) as bin, count(*) as n from n join ed on n.feature = ed.feature group by all), "
        f"cb as ({cats_sql('rc')}), cn as (select cb.feature, coalesce(ca.value, '__other__') as bin, sum(cb.share) as share from cb left join ca on ca.feature = cb.feature and ca.value = cb.value and ca.share >= 0.005 group by all), "
        "ns as (select feature, bin, n / sum(n) over (partition by feature) as share from nb union all select * from cn), "
        "es as (select * from os union all select * from co), "
        "j as (select coalesce(es.feature, ns.feature) as feature, coalesce(es.share, 0) as e, coalesce(ns.share, 0) as a from es full join ns on es.feature = ns.feature and es.bin = ns.bin), "
        f"ps as (select feature, sum({PSI}) as psi from j group by 1), "
        "fn as (select feature, avg((value is null)::int) as null_rate, avg(value) as mean from nl group by 1 union all select feature, coalesce(max(share) filter (where value = '__missing__'), 0), null from cb group by 1), "
        "drift as (select case when feature = '__score__' then 'prediction' else feature end as feature, case when ks_statistic is null then 'categorical' else 'numeric' end as kind, psi, ks_statistic, "
        f"case when ks_statistic is not null then {KS_P} end as ks_pvalue, fo.null_rate as null_rate_ref, fn.null_rate as null_rate_cur, fo.mean as mean_ref, fn.mean as mean_cur, "
        "case when psi >= 0.25 then 'alerta' when psi >= 0.1 then 'warning' else 'estable' end as status from ps left join ks using (feature) join fo using (feature) join fn using (feature))"
    )


def monitor_sql(run: str, run_ts: str, months: int, last: str) -> str:
    """The monitoring row of one run."""
    clock = f"timestamp '{START}' + interval {months - 1} month"
    window = f"issue_month between {clock} - interval 8 month and {clock} - interval 6 month and target_default is not null"
    signals = {
        "auc_degradation": "0.75 - auc >= 0.04", "ks_degradation": "0.4 - ks >= 0.08", "calibration_degradation": "brier - 0.15 >= 0.02",
        "ddm_drift": "state = 'drift'", "page_hinkley_drift": "ph.drift", "prior_shift": f"abs(observed - 0.2) >= 0.03 and abs({PRIOR_Z}) > 1.959963984540054",
    }
    fired = ", ".join(f"case when {rule} then 'concept drift: {name}' end" for name, rule in signals.items())
    return (
        f"with {drift_sql(months)}, lb as (select issue_month as event_ts, request_order as request_id, target_default as y, p as probability from lg where {window}), "
        f"b as (select * from lb where probability is not null), {CONCEPT_CTES}, "
        "enough as (select count(*) as n_labeled, count(*) >= 20 and sum(y) > 0 and sum(1 - y) > 0 as ok from lb), "
        f"concept as (select auc, ks, brier, observed, predicted, state, ph.statistic as statistic, 0.75 - auc >= 0.04 or 0.4 - ks >= 0.08 or (state = 'drift' and ph.drift) as drifted, "
        f"list_filter([{fired}], lambda x: x is not null) as fired from ag, me, ddm, ph), "
        "su as (select list_sort(list(feature) filter (where feature <> 'prediction' and psi >= 0.25)) as hit, max(psi) filter (where feature = 'prediction') as pred from drift), "
        f"al as (select (select count(*) from rc) as n_rows, n_labeled, ok, coalesce(hit, []) as hit, pred, c.*, {last} as last from enough, su left join concept c on true), "
        "wa as (select *, n_rows < 20 as thin, list_filter([case when len(hit) >= 3 then 'data drift en ' || len(hit) || ' features: ' || array_to_string(hit, ', ') end, "
        "case when pred >= 0.2 then 'prediction drift PSI=' || printf('%.3f', pred) end], lambda x: x is not null) || case when ok then fired else [] end as base from al), "
        f"co2 as (select *, len(base) > 0 and coalesce({clock} < last + interval 90 day, false) as cooling from wa) "
        f"select '{run}' as run_id, '{run_ts}' as run_ts, cast(cast({clock} as date) as varchar) as clock_month, '1' as model_version, n_rows, n_labeled, case when thin then 0 else len(hit) end::int as features_drifted, pred as prediction_psi, "
        "case when ok then auc end as roc_auc, case when ok then ks end as ks, case when ok then brier end as brier, case when ok then 0.75 - auc end as auc_drop, case when ok then observed end as default_rate_observed, "
        "case when ok then predicted end as default_rate_predicted, case when ok then state end as ddm_state, case when ok then statistic end as page_hinkley_statistic, coalesce(ok and drifted, false) as concept_drift, "
        "case when thin then 'sin_datos' when coalesce(ok and drifted, false) then 'critico' when len(base) > 0 then 'alerta' else 'estable' end as severity, not thin and len(base) > 0 and not cooling as retrain, "
        "to_json(case when thin then ['ventana con ' || n_rows || ' filas < 20'] else base || case when cooling then ['cooldown activo: se registra la alerta pero no se reentrena'] else [] end end)::varchar as reasons from co2"
    )


MONITORED = (
    f"m1 as ({monitor_sql('monitor-1', '1997-09-03 06:00:00', MONTHS, 'null::timestamp')}), "
    f"m2 as ({monitor_sql('monitor-2', '1997-10-03 06:00:00', MONTHS + 1, '(select max(clock_month)::timestamp from m1 where retrain)')})"
)


@register("p10_monitoring_run", f"with {MONITORED} select * from m1 union all select * from m2")
def monitoring_run(spark, sf):
    """Both monitoring rows in all their columns; the repeated run has added none."""
    rows = monitored(spark, sf).read("monitoring_metrics")
    return rounded(rows.withColumns({"run_ts": F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss"), "clock_month": day("clock_month")}))


@register(
    "p10_monitoring_drift",
    " union all ".join(
        f"select * from (with {drift_sql(m)} select '{run}' as run_id, feature, kind, psi, ks_statistic, ks_pvalue, coalesce(ks_pvalue < 0.01, false) as ks_drift, null_rate_ref, null_rate_cur, mean_ref, mean_cur, status from drift)"
        for run, m in (("monitor-1", MONTHS), ("monitor-2", MONTHS + 1))
    ),
)
def monitoring_drift(spark, sf):
    """The drift rows of both runs."""
    return rounded(monitored(spark, sf).read("drift_by_feature").drop("run_ts", "clock_month", "model_version"))


@register(
    "p10_retrain_events",
    f"with {MONITORED} select run_ts as event_ts, clock_month, 'monitoring' as trigger, reasons, model_version from (select * from m1 union all select * from m2) where retrain",
)
def retrain_events(spark, sf):
    """Events of the runs that asked for one; the second run is inside the cooldown of the first if that fired."""
    rows = monitored(spark, sf).read("retrain_events")
    return rows.withColumns({"event_ts": F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss"), "clock_month": day("clock_month")})

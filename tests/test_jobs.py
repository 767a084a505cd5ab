"""Committed runs, stored profiles, replay and monitoring as jobs."""

import pytest
from pyspark.sql import functions as F

from underwrite import config as C
from underwrite.jobs.monitor import run_monitoring
from underwrite.jobs.profiles import newest_profile, save_profile
from underwrite.jobs.replay import Arms, run_replay
from underwrite.sources.store import COMMIT, OperationalStore

SPEC = C.LoanSpec()
REFERENCE = {"roc_auc": 0.9, "ks": 0.7, "brier": 0.1, "default_rate_observed": 0.2}


@pytest.fixture
def store(spark, tmp_path):
    return OperationalStore(spark, str(tmp_path / "store"))


def test_a_run_counts_only_with_its_manifest(spark, store):
    rows = spark.createDataFrame([("r1", "l1", 1)], "request_id string, loan_id string, actual_default int")
    assert store.read("outcomes").count() == 0 and not store.committed("a")
    assert store.append("a", {"outcomes": rows})
    rows.withColumns({"observed_ts": F.lit(None).cast("timestamp"), "source": F.lit("x")}).write.parquet(f"{store.root}/outcomes/{COMMIT}=died")
    assert [r.request_id for r in store.read("outcomes").collect()] == ["r1"]
    assert not store.append("a", {"outcomes": rows}) and store.read("outcomes").count() == 1
    assert store.append("died", {"outcomes": rows.limit(0), "retrain_events": spark.createDataFrame([], "trigger string")})
    assert store.read("outcomes").count() == 1 and store.read("retrain_events").count() == 0
    assert store.append("7", {}) and store.committed("7")
    assert [r.seq for r in store.runs().orderBy("seq").collect()] == [1, 2, 2, 3]


def test_tables_share_the_step_and_the_schema(spark, store):
    extra = spark.createDataFrame([("f", 2.0, "more")], "feature string, psi double, note string")
    store.append("one", {"drift_by_feature": extra, "monitoring_metrics": spark.createDataFrame([(5,)], "n_rows long")})
    assert store.read("drift_by_feature").first().asDict()["psi"] == 2.0 and "note" not in store.read("drift_by_feature").columns
    assert store.read("monitoring_metrics", "one").first()["n_rows"] == 5 and store.read("monitoring_metrics", "two").count() == 0


def loans(spark, first, months, per_month=40):
    """Feature rows of consecutive months; every third loan defaults, the score follows dti."""
    base = spark.range(months * per_month).withColumns(
        {
            "loan_id": F.col("id").cast("string"),
            "issue_month": F.add_months(F.to_date(F.lit(first)), F.floor(F.col("id") / per_month).cast("int")).cast("timestamp"),
            "target_default": (F.col("id") % 3 == 0).cast("double"),
        }
    )
    numbers = {n: ((F.col("id") * (i + 3)) % 50 + 1).cast("double") for i, n in enumerate(SPEC.numeric_names)}
    return base.withColumns(numbers | {n: F.concat(F.lit("v"), (F.col("id") % 3).cast("string")) for n in SPEC.categorical_names}).drop("id")


RULES = C.ReplayRules(production_start="2020-01-01", production_end="2021-12-01", months_per_run=4)


def replay(store, run, rows):
    return run_replay(store, run, rows, Arms(F.col("dti") / 60, None, threshold=0.5), SPEC, RULES)


def test_replay_goes_on_from_the_committed_log(spark, store):
    rows = loans(spark, "2020-01-01", 6)
    assert replay(store, "a", rows) and not replay(store, "a", rows)
    assert store.read("inference_log").count() == 160 == store.read("outcomes").count()
    assert replay(store, "b", rows) and store.read("inference_log").count() == 240
    assert replay(store, "c", rows) and store.read("inference_log").count() == 240
    assert store.read("inference_log").select("request_id").distinct().count() == 240
    assert {r.variant for r in store.read("inference_log").select("variant").distinct().collect()} == {"champion"}


def profile(store, run, at, rows):
    return save_profile(store, run, "1", at, rows.withColumn("s", F.col("dti") / 60), SPEC.numeric_names[:4], SPEC.categorical_names[:2], "s", REFERENCE)


def test_newest_profile_wins_and_carries_its_metrics(spark, store):
    rows = loans(spark, "2019-01-01", 2)
    assert newest_profile(store, "1") is None
    assert profile(store, "late", "2020-02-01", rows) and profile(store, "early", "2019-02-01", rows.limit(3)) and not profile(store, "late", "2021-01-01", rows)
    held = newest_profile(store, "1")
    assert held.metrics == REFERENCE and held.profile.count() == 7
    assert held.counts.groupBy("feature").agg(F.sum("n").alias("n")).select("n").distinct().collect() == [(80,)]
    with pytest.raises(ValueError):
        save_profile(store, "x", "1", "2020-01-01", rows, ["dti"], [], "dti", {"roc_auc": 1.0})


def test_monitoring_decides_once_per_run_and_cools_down(spark, store):
    rules = C.MonitoringRules(min_rows=50)
    assert not run_monitoring(store, "m0", "2020-01-01", "1", rules=rules)  # no traffic yet
    shifted = loans(spark, "2020-01-01", 12).withColumns({n: F.col(n) * 3 for n in SPEC.numeric_names[:4] if n != "dti"})
    replay(store, "r", shifted)
    assert not run_monitoring(store, "m0", "2020-01-01", "1", rules=rules)  # no profile yet
    profile(store, "p", "2019-12-01", loans(spark, "2019-01-01", 6))
    assert run_monitoring(store, "m1", "2020-05-01", "1", rules=rules) and not run_monitoring(store, "m1", "2020-05-01", "1", rules=rules)
    row = store.read("monitoring_metrics").first()
    assert row.retrain and row.features_drifted >= 3 and row.severity == "alerta" and row.n_labeled == 0 and row.roc_auc is None
    assert store.read("retrain_events").count() == 1 and store.read("drift_by_feature").count() == 7
    replay(store, "r2", shifted)
    assert run_monitoring(store, "m2", "2020-09-01", "1", rules=rules)
    last = store.read("monitoring_metrics", "m2").first()
    assert not last.retrain or last.clock_month >= row.clock_month.replace(month=8)
    assert run_monitoring(store, "m3", "2020-09-02", "1", rules=C.MonitoringRules(min_rows=10_000))
    thin = store.read("monitoring_metrics", "m3").first()
    assert thin.severity == "sin_datos" and thin.features_drifted == 0 and not thin.retrain

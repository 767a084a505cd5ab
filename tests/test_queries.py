"""Registered queries: counterpart results, plan shape, and rules for their names."""

import re

import duckdb
import pytest

from check import TABLES, cell, close
from underwrite.plans import catalog, q_metrics, q_risk

SAMPLE = (
    "a05_tolerant_append b05_right_censoring b10_canonical_projection b25_record_validation c01_delayed_labels c06_row_threshold_grid "
    "d02_expectations d10_categorical_profile d14_feature_drift d18_weight_of_evidence d31_optimal_threshold d36_auc_table "
    "d37_pairwise_comparison d46_reliability_table d48_gains_table d49_vintage_stability d50_spearman w03_ntile w05_ddm "
    "w06_page_hinkley_per_key m11_parsimonious_selection p01_policy_decision p05_monthly_replay p09_retrain_decision p11_arm_aggregates "
    "t01_tumbling_windows t05_idempotent_requests"
).split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_counterpart(spark, sf, oracle, name):
    query = catalog.QUERIES[name]
    df = query.plan(spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = oracle.execute(query.rounded_sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    where = [names.index(c) for c in columns]
    want = sorted((tuple(cell(r[i]) for i in where) for r in result.fetchall()), key=repr)
    assert len(got) == len(want) and all(close(a, b) for a, b in zip(got, want))


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_names():
    assert all(re.fullmatch(r"[abcdmoptuwx]\d\d_[a-z0-9_]+", n) for n in catalog.QUERIES)


def test_metrics_read_the_table_once(spark, sf):
    """All branches of a ranked scan share one exchange of score counts."""
    plan = executed(q_metrics.average_precision(spark, sf))
    assert plan.count("FileScan parquet") <= 1 + plan.count("ReusedExchange")
    assert "ReusedExchange" in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = q_risk.delayed_labels(spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "props" not in plan.split("== Physical Plan ==")[1]

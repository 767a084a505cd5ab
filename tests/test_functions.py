"""Column builders against known values."""

import math

import pytest
from pyspark.sql import functions as F

from underwrite import config as C
from underwrite.functions import calendar as cal
from underwrite.functions import decisions as D
from underwrite.functions import parsing as P
from underwrite.functions import scoring as S
from underwrite.functions import stats as ST
from underwrite.operators.loans import build_features, parse_loans


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def texts(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f("v")).collect()]


def test_numbers_and_months_from_text(spark):
    assert texts(spark, ["13.56%", " 36 months", "", "n/a", None, "-4", "1.2.3"], P.number_from_text) == [
        13.56, 36.0, None, None, None, -4.0, None,
    ]
    months = texts(spark, ["Dec-2015", "Dec-2015 ", "x", None], lambda c: P.month_from_text(c).cast("date").cast("string"))
    assert months == ["2015-12-01", "2015-12-01", None, None]


def test_employment_and_categories(spark):
    assert texts(spark, ["< 1 year", "10+ years", "3 years", "n/a", None], P.employment_years) == [0, 10, 3, None, None]
    aliases = C.CATEGORY_ALIASES["home_ownership"]
    assert texts(spark, ["ANY", "NONE", " RENT ", None], lambda c: P.clean_category(c, aliases)) == [
        "OTHER", "OTHER", "RENT", None,
    ]


RAW = dict(
    id="68407277", loan_amnt="3600", term=" 36 months", int_rate="13.99%", installment="123.03", grade="C", sub_grade="C4",
    emp_length="10+ years", home_ownership="MORTGAGE", annual_inc="55000", verification_status="Not Verified",
    issue_d="Dec-2015", loan_status="Fully Paid", purpose="debt_consolidation", addr_state="PA", dti="5.91",
    delinq_2yrs="0", earliest_cr_line="Aug-2003", fico_range_low="675", fico_range_high="679", inq_last_6mths="1",
    open_acc="7", pub_rec="0", revol_bal="2765", revol_util="29.7%", total_acc="13", initial_list_status="w",
    application_type="Individual", mort_acc="1", pub_rec_bankruptcies="0", total_pymnt="4421",
)


def test_parse_one_loan_and_footer(spark):
    footer = {k: None for k in RAW} | {"id": "Total amount funded in policy code 1: 460296150"}
    schema = ", ".join(f"{k} string" for k in RAW)
    rows = parse_loans(spark.createDataFrame([tuple(RAW.values()), tuple(footer.values())], schema)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["term_months"], r["emp_length_years"], r["fico_score"], r["credit_history_months"]) == (36, 10, 677, 148)
    assert r["target_default"] == 0.0 and r["issue_month"].strftime("%Y-%m") == "2015-12"
    assert "total_pymnt" not in r.asDict() and list(r.asDict()) == C.LoanSpec().canonical_columns


def test_features_need_their_inputs(spark):
    with pytest.raises(ValueError, match="missing input columns"):
        build_features(spark.range(1))


def test_bands_points_and_payment(spark):
    row = one(spark, *[S.risk_band(F.lit(p)) for p in (0.01, 0.07, 0.15, 0.3, 0.5)], S.risk_band(F.lit(None).cast("double")))
    assert list(row) == ["A", "B", "C", "D", "E", None]
    row = one(spark, S.pd_to_points(F.lit(1 / 51)), S.points_to_pd(F.lit(600.0)), S.annuity(F.lit(1200.0), F.lit(0.0), F.lit(12)))
    assert row[0] == pytest.approx(600) and row[1] == pytest.approx(1 / 51) and row[2] == 100


def test_digitize_counts_edges_not_above(spark):
    edges = [1.0, 2.0, 3.0]
    got = one(spark, *[S.digitize(F.lit(x), edges) for x in (0.5, 1.0, 2.5, 3.0, 9.0)], S.digitize(F.lit(None).cast("double"), edges))
    assert list(got) == [0, 1, 2, 3, 3, None]
    array = F.array(*[F.lit(e) for e in edges])
    assert one(spark, S.digitize(F.lit(2.0), array))[0] == 2


@pytest.mark.parametrize(
    "p, decision, reason",
    [
        (0.159, "APROBAR", None), (0.16, "REVISION_MANUAL", "PD_ZONA_GRIS"), (0.179, "REVISION_MANUAL", "PD_ZONA_GRIS"),
        (0.18, "RECHAZAR", "PD_SOBRE_UMBRAL"), (None, "REVISION_MANUAL", "MODELO_NO_DISPONIBLE"),
        (float("nan"), "REVISION_MANUAL", "SALIDA_MODELO_INCOHERENTE"), (1.2, "REVISION_MANUAL", "SALIDA_MODELO_INCOHERENTE"),
    ],
)
def test_policy_boundaries(spark, p, decision, reason):
    d = one(spark, D.decide(F.lit(p).cast("double"), F.lit(0.18), F.lit(60000.0), F.lit(100.0), F.lit(10.0)).alias("d"))["d"]
    assert d["decision"] == decision and (d["reasons"][0] if d["reasons"] else None) == reason
    assert bool(d["reasons"]) == (decision != "APROBAR") and d["policy_version"] == "2026.10-1"


def test_knock_outs_come_first(spark):
    heavy = one(spark, D.decide(F.lit(0.01), F.lit(0.18), F.lit(60000.0), F.lit(2500.0), F.lit(50.0)).alias("d"))["d"]
    assert heavy["decision"] == "RECHAZAR" and heavy["reasons"] == ["CUOTA_INGRESO_ALTA", "DTI_ALTO"]
    missing = one(spark, D.decide(F.lit(0.01), F.lit(0.18), *[F.lit(None).cast("double")] * 3).alias("d"))["d"]
    assert missing["decision"] == "APROBAR"


def test_reasons_are_ordered_and_capped(spark):
    factors = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(v).alias("impact")) for n, v in (("a", 0.1), ("b", 0.9), ("c", -2.0), ("d", 0.5), ("e", 0.4))])
    d = one(spark, D.decide(F.lit(0.5), F.lit(0.18), F.lit(0.0), F.lit(0.0), F.lit(0.0), factors).alias("d"))["d"]
    assert d["reasons"] == ["PD_SOBRE_UMBRAL", "RIESGO_B", "RIESGO_D", "RIESGO_E"]


def test_sticky_assignment(spark):
    assert one(spark, D.traffic_bucket(F.lit("123")))[0] == pytest.approx(0.6888511303553477, abs=1e-15)
    share = spark.range(20000).select(D.assign_variant("id", 0.2).alias("v")).filter("v = 'challenger'").count() / 20000
    assert 0.18 <= share <= 0.22
    assert one(spark, D.assign_variant(F.lit("x"), 0.0))[0] == "champion"


def test_windows_from_a_clock(spark):
    row = one(spark, cal.monitoring_windows(F.to_timestamp(F.lit("2016-12-15")), 3, 6).alias("w"))["w"]
    assert row["drift_start"].strftime("%Y-%m") == "2016-10" and row["label_end"].strftime("%Y-%m") == "2016-06"
    months = cal.months_to_process(*[F.to_timestamp(F.lit(d)) for d in ("2018-11-01", "2014-01-01")], 3, F.to_timestamp(F.lit("2018-12-01")))
    assert [m.strftime("%Y-%m") for m in one(spark, months.alias("m"))["m"]] == ["2018-12"]
    fresh = cal.months_to_process(F.lit(None).cast("timestamp"), F.to_timestamp(F.lit("2014-01-01")), 2, F.to_timestamp(F.lit("2018-12-01")))
    assert [m.strftime("%Y-%m") for m in one(spark, fresh.alias("m"))["m"]] == ["2014-01", "2014-02"]


def test_proportion_tests(spark):
    z = [one(spark, ST.two_proportion_z(*[F.lit(v) for v in args]))[0] for args in ((0, 10, 0, 10), (0, 0, 1, 1), (30, 100, 20, 100))]
    assert z[0] == 0 and z[1] is None and z[2] == pytest.approx(1.63299316)
    p = one(spark, ST.two_sided_p(F.lit(1.959963984540054)))[0]
    assert p == pytest.approx(0.05, abs=1e-12)
    low, high = ST.wilson(F.lit(0), F.lit(0))
    assert list(one(spark, low, high)) == [None, None]


def test_lists_of_reasons(spark):
    rows = texts(spark, ['["a","b"]', "plain", "", None], D.parse_reasons)
    assert rows == [["a", "b"], ["plain"], [], []]


def test_non_finite_values(spark):
    values = [float("nan"), float("inf"), float("-inf"), 1.5]
    got = one(spark, *[P.null_if_not_finite(F.lit(v)) for v in values])
    assert list(got) == [None, None, None, 1.5]


def test_spaced_values_end_exactly():
    grid = S.evenly_spaced(0.02, 0.9, 89)
    assert grid[0] == 0.02 and grid[-1] == 0.9 and math.isclose(grid[1], 0.03)

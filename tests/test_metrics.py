"""Metrics and inference against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from underwrite.config import SelectionRules
from underwrite.operators import analysis as A
from underwrite.operators import comparison as CMP
from underwrite.operators import delong as D
from underwrite.operators import metrics as M
from underwrite.operators.detectors import ddm
from underwrite.operators.quantiles import exact_quantiles
from underwrite.operators.bootstrap import Metric, auc_difference, bootstrap_interval, replicate_metrics, standard_metrics


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        y = int(rng.random() < 0.3)
        strong = min(0.99, max(0.01, rng.gauss(0.3 + 0.2 * y, 0.15)))
        rows.append((i, y, round(strong, 2), round(strong + rng.gauss(0, 0.005), 3), round(rng.random(), 2), "g" if i % 3 else "h"))
    return rows, spark.createDataFrame(rows, "id bigint, y int, strong double, twin double, weak double, g string").cache()


def pair_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()


def placements(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])
    return wins.mean(axis=1), wins.mean(axis=0)


def arrays(rows, column, group=None):
    kept = [r for r in rows if group is None or r[5] == group]
    return np.array([r[1] for r in kept]), np.array([r[column] for r in kept])


def test_grouped_auc_equals_pair_count(scored):
    rows, df = scored
    for r in M.classification_report(df, "y", "strong", 0.4, ["g"]).collect():
        y, s = arrays(rows, 2, r["g"])
        assert r["roc_auc"] == pytest.approx(pair_auc(y, s), abs=1e-12)
        assert r["brier"] == pytest.approx(((s - y) ** 2).mean())
        cut = np.unique(s)
        ks = max(abs((s[y == 1] <= c).mean() - (s[y == 0] <= c).mean()) for c in cut)
        assert r["ks"] == pytest.approx(ks)
        tp, flagged = ((s >= 0.4) & (y == 1)).sum(), (s >= 0.4).sum()
        assert r["precision"] == pytest.approx(tp / flagged) and r["recall"] == pytest.approx(tp / y.sum())


def test_one_class_has_no_ranking(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    r = M.classification_report(df, "y", "p").first()
    assert r["roc_auc"] is None and r["ks"] is None and r["pr_auc"] is None and r["default_rate_observed"] == 1
    assert D.auc_interval(df, "y", "p").first()["auc"] is None


def test_missing_labels_and_scores_are_skipped(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (None, 0.5), (1, None), (0, float("nan"))], "y int, p double")
    r = M.classification_report(df, "y", "p").first()
    assert r["n"] == 2 and r["roc_auc"] == 1.0


def test_delong_moments(scored):
    rows, df = scored
    y, s = arrays(rows, 2)
    v01, v10 = placements(y, s)
    r = D.auc_interval(df, "y", "strong").first()
    assert r["se"] == pytest.approx(math.sqrt(v01.var(ddof=1) / len(v01) + v10.var(ddof=1) / len(v10)), rel=1e-9)
    pair = D.paired_tests(df, "y", ["strong", "weak"]).first()
    w01, w10 = placements(y, arrays(rows, 4)[1])
    se = math.sqrt((v01 - w01).var(ddof=1) / len(v01) + (v10 - w10).var(ddof=1) / len(v10))
    assert pair["se"] == pytest.approx(se, rel=1e-9)
    assert pair["p_value"] == pytest.approx(math.erfc(abs(pair["z"]) / math.sqrt(2)))
    same = D.paired_tests(df.withColumn("copy", F.col("strong")), "y", ["strong", "copy"]).first()
    assert (same["z"], same["p_value"]) == (0.0, 1.0)


def test_holm_known_values(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.04, 0.001, 0.03))], "i int, p double")
    got = {r["i"]: r["p_holm"] for r in CMP.holm(df, "p", [], "i").collect()}
    assert [got[i] for i in range(3)] == pytest.approx([0.06, 0.003, 0.06])
    assert CMP.holm(df.limit(0), "p", [], "i").count() == 0
    with pytest.raises(PySparkException):
        CMP.holm(spark.createDataFrame([(0, 1.5)], "i int, p double"), "p", [], "i").collect()


def test_simplest_model_that_is_not_worse(scored):
    _, df = scored
    complexity = {"strong": 2, "twin": 1, "weak": 1}
    rows = {r["model"]: r for r in CMP.select_parsimonious(df, "y", ["strong", "twin", "weak"], complexity, rules=SelectionRules(practical_margin=0.02)).collect()}
    assert rows["twin"]["selected"] and not rows["weak"]["retained"]
    only = CMP.select_parsimonious(df, "y", ["strong", "twin", "weak"], complexity, ["strong", "weak"]).filter("selected").first()
    assert only["model"] == "strong"
    with pytest.raises(ValueError):
        CMP.select_parsimonious(df, "y", ["strong"], complexity, ["absent"])


def test_thresholds_against_rows(scored):
    rows, df = scored
    y, s = arrays(rows, 2)
    costs = [5 * ((s < t) & (y == 1)).sum() + ((s >= t) & (y == 0)).sum() for t in M.THRESHOLD_GRID]
    best = M.optimal_threshold(df, "y", "strong").first()
    assert best["cost"] == min(costs) and best["threshold"] == M.THRESHOLD_GRID[int(np.argmin(costs))]
    curve = {r["threshold"]: r for r in M.threshold_curve(df, "y", "strong").collect()}
    assert len(curve) == 59
    t = M.CURVE_GRID[20]
    assert curve[t]["approval_rate"] == pytest.approx((s < t).mean())
    assert curve[t]["bad_rate_approved"] == pytest.approx(y[s < t].mean())


def test_reliability_drops_empty_bins(spark):
    rows = [(i % 2, p) for p, n in ((0.1, 400), (0.2, 200), (0.3, 400)) for i in range(n)]
    table = A.reliability_table(spark.createDataFrame(rows, "y int, p double"), "y", "p").orderBy("bin").collect()
    assert [r["n"] for r in table] == [400, 200, 400]


def test_calibration_line_recovers_its_parameters(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(0.02, 0.6, 20000)
    y = (rng.random(20000) < p).astype(int)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y int, p double")
    line = A.calibration_line(df, "y", "p").first()
    assert line["slope"] == pytest.approx(1, abs=0.06) and line["intercept"] == pytest.approx(0, abs=0.1)


def test_deciles_add_up(scored):
    _, df = scored
    table = A.decile_table(df, "y", "strong", "id").orderBy("decile").collect()
    assert [r["n"] for r in table] == [60] * 10 and table[-1]["cum_capture"] == pytest.approx(1)
    assert table[0]["default_rate"] > table[-1]["default_rate"]


def test_bootstrap_brackets_the_estimate(scored):
    rows, df = scored
    y, s = arrays(rows, 2)
    got = {r["metric"]: r for r in bootstrap_interval(df, "y", "strong", n=200).collect()}
    assert got["roc_auc"]["estimate"] == pytest.approx(pair_auc(y, s))
    report = M.classification_report(df, "y", "strong").first()
    assert got["ks"]["estimate"] == pytest.approx(report["ks"]) and got["pr_auc"]["estimate"] == pytest.approx(report["pr_auc"])
    exact = D.auc_interval(df, "y", "strong").first()
    width = got["roc_auc"]["ci_high"] - got["roc_auc"]["ci_low"]
    assert width == pytest.approx(exact["ci_high"] - exact["ci_low"], rel=0.25)
    for r in got.values():
        assert r["ci_low"] < r["estimate"] < r["ci_high"] and r["n_boot"] == 200


def test_bootstrap_draws_repeat_and_skip_lost_classes(spark, scored):
    _, df = scored
    auc = {"auc": standard_metrics()["roc_auc"]}
    a = replicate_metrics(df, "y", "strong", auc, 20).orderBy("replicate").collect()
    b = replicate_metrics(df.repartition(7), "y", "strong", auc, 20).orderBy("replicate").collect()
    assert a == b
    tiny = spark.createDataFrame([(1, 0.9), (0, 0.1)], "y int, p double")
    assert 1 < replicate_metrics(tiny, "y", "p", auc, 100).count() < 101


def test_difference_of_independent_arms(scored):
    rows, df = scored
    arms = df.withColumn("arm", F.when(F.col("id") % 2 == 0, "a").otherwise("b")).withColumn(
        "p", F.when(F.col("arm") == "b", F.col("strong")).otherwise(F.col("weak"))
    )
    r = auc_difference(arms, "y", "p", "arm", "a", "b", 200).first()
    assert r["ci_low"] > 0 and r["p_value"] < 0.05 and r["ci_low"] < r["auc_diff"] < r["ci_high"]


def test_a_null_key_is_a_group_of_its_own(spark, scored):
    """The same rows under NULL and under a name give the same numbers everywhere."""
    df = scored[1].select("id", "y", "strong", "weak", F.explode(F.array(F.lit("a"), F.lit(None))).alias("k"))
    results = [
        M.classification_report(df, "y", "strong", keys=["k"]),
        M.optimal_threshold(df, "y", "strong", keys=["k"]),
        M.curve_points(df, "y", "strong", 20, ["k"]),
        D.auc_interval(df, "y", "strong", ["k"]),
        D.paired_tests(df, "y", ["strong", "weak"], ["k"]),
        A.spearman(df, ["k"], "strong", "weak"),
        exact_quantiles(df, ["k"], "strong", [0.25, 0.5]),
        ddm(df, "y", ["id"], ["k"]),
    ]
    for result in results:
        rows = [r.asDict() for r in result.collect()]
        named, null = ([{c: v for c, v in r.items() if c != "k"} for r in rows if r["k"] == k] for k in ("a", None))
        assert named and len(named) == len(null)
        assert sorted(map(repr, named)) == sorted(map(repr, null)) or all(
            a[c] == (pytest.approx(b[c], rel=1e-9) if isinstance(b[c], float) else b[c]) for a, b in zip(sorted(named, key=repr), sorted(null, key=repr)) for c in a
        )


def test_roc_corners_drop_the_points_on_lines(spark):
    draw = random.Random(6)
    rows = [(int(draw.random() < s / 12), s / 12.0, k) for k in ("a", None) for s in range(1, 12) for _ in range(draw.randint(1, 4))]
    rows += [(0, 2.0 + i, k) for k in ("a", None) for i in range(9)]  # a straight stretch
    df = spark.createDataFrame(rows, "y int, p double, k string")
    got = M.roc_corners(df, "y", "p", 1000, ["k"]).collect()
    for key in ("a", None):
        counts = {}
        for y, s, k in rows:
            if k == key:
                counts.setdefault(s, [0, 0])[y] += 1
        scores = sorted(counts, reverse=True)
        fps, tps = np.cumsum([[counts[s][0], counts[s][1]] for s in scores], axis=0).T
        turns = np.flatnonzero(np.r_[True, (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0), True])
        points = sorted((r.fpr, r.tpr) for r in got if r.k == key)
        want = sorted(zip(fps[turns] / fps[-1], tps[turns] / tps[-1]))
        assert len(points) == len(want) and np.allclose(points, want)
        assert sum(1.0 < r.threshold < 11.0 for r in got if r.k == key) < 9


def test_draws_follow_the_poisson_law(spark):
    """Mean, spread and the share of zeros of the weights of small and large counts over many replicates."""
    rows = spark.createDataFrame([(1, i / 1000.0) for i in range(100)] + [(1, 0.5)] * 6 + [(1, 0.7)] * 60, "y int, p double").unionByName(
        spark.createDataFrame([(0, 0.1)] * 3, "y int, p double")
    )
    size = {"w": Metric(lambda score, pos, neg, pos_cum, neg_cum, pos_all, neg_all: F.when(score == 0.7, pos).otherwise(F.lit(0.0))),
            "six": Metric(lambda score, pos, *rest: F.when(score == 0.5, pos).otherwise(F.lit(0.0))),
            "none": Metric(lambda score, pos, *rest: F.when((score < 0.1) & (pos == 0), F.lit(1.0)).otherwise(F.lit(0.0)))}
    drawn = replicate_metrics(rows, "y", "p", size, 400).where("replicate > 0")
    r = drawn.agg(F.avg("w").alias("m"), F.variance("w").alias("v"), F.avg("six").alias("m6"), F.variance("six").alias("v6"), F.avg("none").alias("zero")).first()
    assert r.m == pytest.approx(60, abs=2) and r.v == pytest.approx(60, rel=0.3)
    assert r.m6 == pytest.approx(6, abs=0.6) and r.v6 == pytest.approx(6, rel=0.35)
    assert r.zero == pytest.approx(100 * math.exp(-1), abs=3)


def test_calibration_line_says_when_there_is_none(spark):
    flat = spark.createDataFrame([(i % 2, 0.3) for i in range(20)], "y int, p double")
    assert A.calibration_line(flat, "y", "p").first().slope is None
    with pytest.raises(ArithmeticError):
        A.calibration_line(spark.createDataFrame([(int(i > 10), 0.02 + i / 30) for i in range(22)], "y int, p double"), "y", "p")


def test_discrimination_block_by_key(scored):
    df = scored[1].withColumn("k", F.when(F.col("id") % 2 == 0, "even"))
    rows = A.discrimination_block(df, "y", "strong", 60, ["k"]).collect()
    assert {r.k for r in rows} == {"even", None}
    for r in rows:
        assert r.ks_ci_low < r.ks < r.ks_ci_high and r.pr_auc_ci_low < r.pr_auc < r.pr_auc_ci_high and r.auc_ci_low < r.auc < r.auc_ci_high

"""Model fitting, out-of-time evaluation and the evidence around it.

Fits are iterative, so these entries have no SQL counterpart unless a closed form exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underwrite.operators import analysis as A
from underwrite.operators import comparison as CMP
from underwrite.operators import explain as X
from underwrite.operators import metrics as M
from underwrite.operators import models as ML
from underwrite.operators import preprocessing as PP
from underwrite.operators.delong import auc_table, paired_tests
from underwrite.plans import oracles as O
from underwrite.plans.q_loans import CUTS_ALL, SPEC, features_at
from underwrite.plans.registry import register, rounded
from underwrite.session import materialize

TARGET = SPEC.target


def splits(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled features of all loans (late snapshot, so every term has ended) with their period."""
    rows = PP.out_of_time_splits(features_at(spark, sf, "2019-01-01"), SPEC, *CUTS_ALL)
    return materialize(rows, "splits")


def matrix_of(data: DataFrame) -> ML.Matrix:
    return ML.training_matrix(data, TARGET, ["loan_id"], PP.Preprocessor(SPEC).fit(data.filter("split = 'train'")))


@register("m05_logistic_candidate")
def logistic_candidate(spark, sf):
    matrix = matrix_of(splits(spark, sf))
    model = ML.fit_model("logistic_regression", matrix)
    scored = ML.score_side_by_side({"p": model}, matrix, ["loan_id"])
    return rounded(M.classification_report(scored, "_y", "p", model.threshold, ["split"]))


@register("m06_tree_candidates")
def tree_candidates(spark, sf):
    matrix = matrix_of(splits(spark, sf))
    models = {n: ML.fit_model(n, matrix) for n in ("gradient_boosting", "random_forest")}
    scored = ML.score_side_by_side(models, matrix, ["loan_id"])
    return rounded(auc_table(scored, "_y", list(models), ["split"]))


@register("m07_random_search")
def random_search(spark, sf):
    _, history = ML.tune("logistic_regression", matrix_of(splits(spark, sf)))
    rows = [(h["trial"], float(h["params"]["C"]), h["train_auc"], h["val_auc"], h["score"]) for h in history]
    return rounded(spark.createDataFrame(rows, "trial int, c double, train_auc double, val_auc double, score double"))


@register("m08_benchmark")
def benchmark(spark, sf):
    matrix = matrix_of(splits(spark, sf))
    models = {n: ML.fit_model(n, matrix) for n in ML.CANDIDATES}
    scored = ML.score_side_by_side(models, matrix, ["loan_id"])
    return rounded(ML.benchmark(scored, {n: m.threshold for n, m in models.items()}))


@register("m17_batch_scoring")
def batch_scoring(spark, sf):
    data = splits(spark, sf)
    model = ML.fit_model("logistic_regression", matrix_of(data))
    frame = model.predict_frame(data, ["loan_id"], SPEC.labels)
    return rounded(frame.withColumn("top_factors", F.to_json("top_factors")))


@register("m19_ablation")
def ablation(spark, sf):
    data = splits(spark, sf)
    matrix = matrix_of(data)
    test = ML.ablation(ML.fit_model("logistic_regression", matrix), matrix, data, TARGET)
    return rounded(test.withColumn("gini_kept", A.gini_kept("auc_a", "auc_b")))


@register("m20_tuning_effect")
def tuning_effect(spark, sf):
    matrix = matrix_of(splits(spark, sf))
    params, _ = ML.tune("logistic_regression", matrix)
    default = ML.fit_model("logistic_regression", matrix)
    tuned = ML.fit_model("logistic_regression", matrix, params)
    return rounded(ML.tuning_effect(default, tuned, matrix))


@register("m21_evidence_pack")
def evidence_pack(spark, sf):
    """Row counts of every table of the evidence pack, each table written once."""
    data = splits(spark, sf)
    model = ML.fit_model("logistic_regression", matrix_of(data))
    prepared = model.preprocessor
    scored = model.with_probability(data, "final").withColumn("rank_id", F.xxhash64("loan_id"))
    narrow = materialize(scored.select("loan_id", "rank_id", "split", "issue_month", "fico_score", TARGET, "final"), "evidence")
    test = narrow.filter("split = 'test'").withColumn("by_fico", 1 - F.col("fico_score") / 1000)
    contributions = model.contributions()
    tables = {
        "sizes": A.split_summary(narrow, "split", "issue_month", TARGET),
        "auc": auc_table(test, TARGET, ["final", "by_fico"]),
        "pairs": CMP.pairwise_comparison(test, TARGET, ["final", "by_fico"]),
        "calibration": A.calibration_summary(test, TARGET, "final"),
        "reliability": A.reliability_table(test, TARGET, "final"),
        "deciles": A.decile_table(test, TARGET, "final", "rank_id"),
        "thresholds": M.threshold_curve(test, TARGET, "final"),
        "curves": M.curve_points(test, TARGET, "final"),
        "vintages": A.vintage_stability(narrow.filter("split <> 'train'"), TARGET, "final", "issue_month"),
        "importance": X.contribution_summary(data.filter("split = 'test'"), contributions, prepared.numeric_columns),
    }
    out = None
    for name, table in tables.items():
        size = materialize(table, name).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        out = size if out is None else out.unionByName(size)
    return out


@register(
    "x02_ranking_of_single_variable",
    f"with {O.features_at('2019-01-01')}, b as (select cast(target_default as int) as y, 1 - fico_score / 1000.0e0 as p, 1 - annual_inc / 1e6 as q from features "
    f"where target_default is not null and fico_score is not null and annual_inc is not null), {O.counted('b', 'y', 'p')}, {O.delong()} select auc, se from d",
)
def single_variable(spark, sf):
    rows = features_at(spark, sf, "2019-01-01").filter(F.col("annual_inc").isNotNull())
    scored = rows.withColumns({"p": 1 - F.col("fico_score") / 1000, "q": 1 - F.col("annual_inc") / 1e6})
    table = paired_tests(scored, TARGET, ["p", "q"]).select(F.col("auc_a").alias("auc"))
    se = auc_table(scored.filter(F.col("fico_score").isNotNull()), TARGET, ["p"]).select("se").scalar()
    return rounded(table.withColumn("se", se))

"""Candidate models on pyspark.ml, fitted and evaluated out of time."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite.config import MISSING, OTHER, QualityGates, SelectionRules
from underwrite.functions.parsing import dec, lookup
from underwrite.functions.scoring import risk_band
from underwrite.operators.delong import auc_interval, long_scores, paired_tests
from underwrite.operators.explain import factor_array, top_factors
from underwrite.operators.metrics import classification_report, diagnose_fit, optimal_threshold
from underwrite.operators.preprocessing import Preprocessor
from underwrite.session import materialize

CANDIDATES = ("logistic_regression", "gradient_boosting", "random_forest")
DEFAULT_PARAMS: dict[str, dict] = {
    "logistic_regression": {"C": 0.5},
    "gradient_boosting": {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8},
    "random_forest": {"numTrees": 40, "maxDepth": 6, "minInstancesPerNode": 30},
}


def draw_params(name: str, rng: random.Random) -> dict:
    """One random point of a candidate's search space."""
    if name == "logistic_regression":
        return {"C": 10 ** rng.uniform(-3, 1)}
    if name == "gradient_boosting":
        return {
            "maxIter": rng.choice([10, 20, 30]),
            "maxDepth": rng.randint(3, 6),
            "stepSize": 10 ** rng.uniform(-1.5, -0.5),
            "subsamplingRate": rng.uniform(0.6, 1.0),
        }
    if name == "random_forest":
        return {"numTrees": rng.choice([20, 40, 60]), "maxDepth": rng.randint(4, 8)}
    raise ValueError(f"unknown candidate: {name}")


@dataclass
class Matrix:
    """Model matrix of all periods, written once and shared by every fit and evaluation.

    ``rows`` holds the kept columns, ``split``, the label ``_y`` and the vector ``_x``.
    """

    preprocessor: Preprocessor
    rows: DataFrame

    def period(self, *names: str) -> DataFrame:
        return self.rows.filter(F.col("split").isin(*names))


def training_matrix(
    splits: DataFrame, target: str, keep: Sequence[str] = (), preprocessor: Preprocessor | None = None
) -> Matrix:
    """Fit the preprocessor on the training period (unless given) and vectorise all periods."""
    fitted = preprocessor or Preprocessor().fit(splits.filter("split = 'train'"))
    columns = fitted.columns()
    wide = splits.select(
        *keep,
        "split",
        F.col(target).cast("double").alias("_y"),
        *[c.alias(f"m{i}") for i, c in enumerate(columns.values())],
    )
    inputs = [f"m{i}" for i in range(len(columns))]
    vectors = VectorAssembler(inputCols=inputs, outputCol="_x").transform(wide).select(*keep, "split", "_y", "_x")
    return Matrix(fitted, materialize(vectors, "matrix"))


@dataclass
class CreditModel:
    """Preprocessor, fitted stages and decision threshold."""

    name: str
    preprocessor: Preprocessor
    params: dict = field(default_factory=dict)
    threshold: float = 0.5
    stages: list = field(default_factory=list)
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    coefficients: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0

    def fit(self, matrix: Matrix) -> CreditModel:
        train = matrix.period("train")
        params = {**DEFAULT_PARAMS[self.name], **self.params}
        if self.name == "logistic_regression":
            return self._fit_logistic(train, params["C"])
        kinds = {"gradient_boosting": GBTClassifier, "random_forest": RandomForestClassifier}
        self.stages = [kinds[self.name](featuresCol="_x", labelCol="_y", seed=42, **params).fit(train)]
        return self

    def _fit_logistic(self, train: DataFrame, c: float) -> CreditModel:
        """Penalty 1 / (C n) on columns scaled by their population deviation.

        The scaler divides by the sample deviation, which differs by sqrt((n - 1) / n) for every
        column alike; the same factor on the penalty gives the same fit.
        """
        n = train.count()
        scaler = StandardScaler(inputCol="_x", outputCol="_scaled", withMean=True, withStd=True).fit(train)
        penalty = (n - 1) / (c * n * n)
        fitted = LogisticRegression(
            featuresCol="_scaled",
            labelCol="_y",
            regParam=penalty,
            elasticNetParam=0.0,
            standardization=False,
            maxIter=100,
        ).fit(scaler.transform(train))
        names = list(self.preprocessor.columns())
        self.stages = [scaler, fitted]
        self.means = dict(zip(names, [float(v) for v in scaler.mean], strict=True))
        self.deviations = dict(zip(names, [float(v) for v in scaler.std], strict=True))
        self.coefficients = dict(zip(names, [float(v) for v in fitted.coefficients], strict=True))
        self.intercept = float(fitted.intercept)
        return self

    def transform(self, vectors: DataFrame, name: str = "probability") -> DataFrame:
        """Probability next to the columns of a vectorised frame."""
        columns = vectors.columns
        for stage in self.stages:
            vectors = stage.transform(vectors)
        return vectors.select(*columns, F.get(vector_to_array("probability"), F.lit(1)).alias(name))

    def _weight(self, column: str) -> float:
        """Log-odds per unit of an unscaled column; a constant column weighs nothing."""
        spread = self.deviations[column]
        return self.coefficients[column] / spread if spread > 0 else 0.0

    def contributions(self) -> dict[str, Column]:
        """Log-odds contribution per original variable (logistic candidate).

        A category adds one looked-up constant: its own weight less the mean of all its dummies.
        """
        if not self.coefficients:
            raise RuntimeError("contributions exist for the fitted logistic candidate only")
        fitted, out = self.preprocessor, {}
        for n in fitted.numeric_columns:
            value = F.coalesce(F.col(n), dec(fitted.medians[n]))
            part = (value - dec(self.means[n])) * dec(self._weight(n))
            flag = f"{n}={MISSING}"
            if n in fitted.indicators:
                base = -self.means[flag] * self._weight(flag)
                part = part + F.when(F.col(n).isNull(), dec(self._weight(flag) + base)).otherwise(dec(base))
            out[n] = part
        for n, values in fitted.vocabulary.items():
            dummies = [f"{n}={v}" for v in [*values, OTHER]]
            base = -sum(self.means[d] * self._weight(d) for d in dummies)
            other = dec(base + self._weight(f"{n}={OTHER}"))
            known = {v: base + self._weight(f"{n}={v}") for v in values}
            out[n] = F.coalesce(lookup(known, F.coalesce(F.col(n), F.lit(MISSING))), other) if known else other
        return out

    def with_probability(self, features: DataFrame, name: str = "probability") -> DataFrame:
        """Feature rows plus their probability; the logistic candidate stays a plain projection."""
        if self.name == "logistic_regression":
            total = dec(self.intercept)
            for part in self.contributions().values():
                total = total + part
            return features.withColumn(name, dec(1) / (dec(1) + F.exp(-total)))
        columns = list(self.preprocessor.columns().values())
        wide = features.select("*", *[c.alias(f"_m{i}") for i, c in enumerate(columns)])
        inputs = [f"_m{i}" for i in range(len(columns))]
        vectors = VectorAssembler(inputCols=inputs, outputCol="_x").transform(wide).drop(*inputs)
        return self.transform(vectors, name).drop("_x")

    def predict_frame(self, features: DataFrame, keep: Sequence[str], labels: dict[str, str], k: int = 3) -> DataFrame:
        """Batch scoring: probability, decision, band, threshold, strongest factors."""
        scored = self.with_probability(features, "_p")
        contributions = self.contributions() if self.coefficients else {}
        return scoring_frame(scored, F.col("_p"), contributions, self.threshold, labels, keep, k)


def scoring_frame(
    rows: DataFrame, probability: Column, contributions: Mapping[str, Column], threshold: float, labels: dict[str, str], keep: Sequence[str], k: int = 3
) -> DataFrame:
    """(keep, probability, decision, risk_band, threshold, top_factors); a model without contributions has no factors."""
    return rows.select(
        *keep,
        probability.alias("probability"),
        F.when(probability >= threshold, "RECHAZAR").otherwise("APROBAR").alias("decision"),
        risk_band(probability).alias("risk_band"),
        dec(threshold).alias("threshold"),
        top_factors(factor_array(contributions), labels, k).alias("top_factors"),
    )


def fit_model(
    name: str, matrix: Matrix, params: dict | None = None, rules: SelectionRules | None = None
) -> CreditModel:
    """Fit on the training period, choose the threshold on validation."""
    rules = rules or SelectionRules()
    model = CreditModel(name, matrix.preprocessor, params or {}).fit(matrix)
    validation = model.transform(matrix.period("validation"), "_p")
    best = optimal_threshold(validation, "_y", "_p", rules.cost_fn, rules.cost_fp).first()
    model.threshold = best["threshold"]
    return model


def score_side_by_side(models: Mapping[str, CreditModel], matrix: Matrix, keep: Sequence[str]) -> DataFrame:
    """One probability column per model, written once: every metric reads the same small table."""
    scored = matrix.rows
    for name, model in models.items():
        scored = model.transform(scored, f"p_{name}")
    narrow = scored.select(*keep, "split", "_y", *[F.col(f"p_{n}").alias(n) for n in models])
    return materialize(narrow, "scores")


def benchmark(scored: DataFrame, thresholds: Mapping[str, float], split: str = "split") -> DataFrame:
    """(algorithm, AUC, KS, Brier, ... per split, gap, diagnosis) for all models in one long pass."""
    long = long_scores(scored, "_y", list(thresholds), [split])
    report = classification_report(long, "y", "p", 0.5, [split, "model"])
    picks = []
    for name in ("train", "validation", "test"):
        for metric in ("roc_auc", "pr_auc", "ks", "brier", "log_loss", "ece"):
            picks.append(F.max(F.when(F.col(split) == name, F.col(metric))).alias(f"{name}_{metric}"))
    wide = report.groupBy(F.col("model").alias("algorithm")).agg(*picks)
    cuts = F.create_map(*[F.lit(v) for item in thresholds.items() for v in item])
    return wide.select(
        "*",
        (F.col("train_roc_auc") - F.col("validation_roc_auc")).alias("val_auc_gap"),
        (F.col("train_roc_auc") - F.col("test_roc_auc")).alias("auc_gap"),
        diagnose_fit("train_roc_auc", "test_roc_auc").alias("fit_diagnosis"),
        F.element_at(cuts, F.col("algorithm")).alias("threshold"),
    )


def penalised_score(train_auc: float, val_auc: float, max_gap: float) -> float:
    """Validation AUC less the part of the train gap that exceeds the gate."""
    return val_auc - max(0.0, train_auc - val_auc - max_gap)


def tune(
    name: str, matrix: Matrix, trials: int = 5, seed: int = 42, gates: QualityGates | None = None
) -> tuple[dict, list[dict]]:
    """Random search on the fixed out-of-time validation period.

    Returns the best parameters and one record per trial. Fits are distributed by pyspark.ml; the
    driver only walks the trial list.
    """
    gates = gates or QualityGates()
    rng = random.Random(seed)
    history = []
    for trial in range(trials):
        params = draw_params(name, rng)
        model = CreditModel(name, matrix.preprocessor, params).fit(matrix)
        rows = model.transform(matrix.period("train", "validation"), "_p")
        auc = {r["split"]: r["auc"] for r in auc_interval(rows, "_y", "_p", ["split"]).collect()}
        score = penalised_score(auc["train"], auc["validation"], gates.max_overfit_gap)
        history.append(
            {"trial": trial, "params": params, "train_auc": auc["train"], "val_auc": auc["validation"], "score": score}
        )
    best = max(history, key=lambda h: h["score"])
    return best["params"], history


# Outputs of the lender's own scoring, held constant in the ablation.
NEUTRAL_VALUES = {"grade": "N/A", "sub_grade": "N/A", "int_rate": 0.0}


def neutralise(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.lit(v) for n, v in NEUTRAL_VALUES.items()})


def ablation(model: CreditModel, matrix: Matrix, splits: DataFrame, target: str, id_column: str = "loan_id") -> DataFrame:
    """Refit without the lender's own score and compare both on the same test rows."""
    reduced = training_matrix(neutralise(splits), target, [id_column])
    without = fit_model(model.name, reduced, model.params)
    full = model.transform(matrix.period("test"), "full").select(id_column, "_y", "full")
    other = without.transform(reduced.period("test"), "without").select(id_column, "without")
    return paired_tests(full.join(other, id_column), "_y", ["full", "without"])


def tuning_effect(default: CreditModel, tuned: CreditModel, matrix: Matrix) -> DataFrame:
    """Tuned against default parameters on validation and test."""
    scored = score_side_by_side({"tuned": tuned, "untuned": default}, matrix, [])
    rows = scored.filter(F.col("split").isin("validation", "test"))
    return paired_tests(rows, "_y", ["tuned", "untuned"], ["split"])

"""Points scorecard: logistic regression on WoE columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite.config import SCORECARD_MISSING_CODE, SCORECARD_OTHER
from underwrite.functions.parsing import dec
from underwrite.functions.scoring import digitize, pd_to_points, point_factor, point_offset
from underwrite.operators.binning import bin_label, fit_bins


@dataclass
class Scorecard:
    """Fitted bins (a few rows per feature) and coefficients; scoring is one projection."""

    numeric: Sequence[str]
    categorical: Sequence[str]
    max_bins: int = 10
    min_share: float = 0.01
    regularization_c: float = 1.0
    bins: list[dict] = field(default_factory=list)
    coefficients: dict[str, float] = field(default_factory=dict)
    intercept: float | None = None

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def fit(self, df: DataFrame, target: str) -> Scorecard:
        table = fit_bins(df, target, self.numeric, self.categorical, self.max_bins, self.min_share)
        self.bins = [r.asDict() for r in table.collect()]
        labelled = df.filter(F.col(target).isNotNull()).select(
            F.col(target).cast("double").alias("_y"), *[c.alias(n) for n, c in self.woe_columns().items()]
        )
        rows = labelled.count()
        matrix = VectorAssembler(inputCols=self.features, outputCol="_x").transform(labelled)
        fitted = LogisticRegression(
            featuresCol="_x",
            labelCol="_y",
            regParam=1.0 / (self.regularization_c * rows),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=200,
            tol=1e-9,
        ).fit(matrix)
        self.coefficients = dict(zip(self.features, [float(v) for v in fitted.coefficients], strict=True))
        self.intercept = float(fitted.intercept)
        return self

    def woe_column(self, feature: str) -> Column:
        """WoE of the bin a value falls into; a bin never seen in training counts 0."""
        rows = [b for b in self.bins if b["feature"] == feature]
        woe = {b["code"]: b["woe"] for b in rows}
        empty = dec(woe.get(SCORECARD_MISSING_CODE, 0.0))
        if feature in self.categorical:
            levels = rows[0]["levels"]
            other = levels.index(SCORECARD_OTHER) if SCORECARD_OTHER in levels else len(levels)
            chain = F.when(F.col(feature).isNull(), empty)
            for code, level in enumerate(levels):
                if level != SCORECARD_OTHER:
                    chain = chain.when(F.col(feature) == level, dec(woe.get(code, 0.0)))
            return chain.otherwise(dec(woe.get(other, 0.0)))
        edges = rows[0]["edges"]
        weights = F.array(*[dec(woe.get(code, 0.0)) for code in range(len(edges) + 1)])
        value = F.when(~F.isnan(feature), F.col(feature))
        return F.coalesce(F.get(weights, digitize(value, edges)), empty)

    def woe_columns(self) -> dict[str, Column]:
        return {f: self.woe_column(f) for f in self.features}

    def probability(self) -> Column:
        if self.intercept is None:
            raise RuntimeError("the scorecard is not fitted; call fit()")
        total = dec(self.intercept)
        for feature, column in self.woe_columns().items():
            total = total + dec(self.coefficients[feature]) * column
        return dec(1) / (dec(1) + F.exp(-total))

    def points(self) -> Column:
        return pd_to_points(self.probability())

    def points_table(self, df: DataFrame) -> DataFrame:
        """Points each bin contributes. ``df`` only lends its session."""
        schema = (
            "feature string, kind string, edges array<double>, levels array<string>, code int, n bigint, "
            "share double, bad_rate double, woe double, iv_contribution double"
        )
        table = df.sparkSession.createDataFrame(self.bins, schema)
        pairs = [F.lit(v) for item in self.coefficients.items() for v in item]
        coefficient = F.element_at(F.create_map(*pairs), F.col("feature"))
        return points_of_bins(table, coefficient, self.intercept, len(self.features))


def points_of_bins(bins: DataFrame, coefficient: Column, intercept: float, features: int) -> DataFrame:
    """Every bin with its share of the total score."""
    points = -(coefficient * F.col("woe") + dec(intercept / features)) * dec(point_factor()) + dec(
        point_offset() / features
    )
    return bins.select(
        "feature",
        bin_label(F.col("code"), F.col("edges"), F.col("levels")).alias("bin"),
        "code",
        "n",
        "share",
        "bad_rate",
        "woe",
        "iv_contribution",
        coefficient.alias("coefficient"),
        points.alias("points"),
    )

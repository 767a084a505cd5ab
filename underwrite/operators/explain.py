"""Contributions of a linear model per row, and what follows from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite.functions.parsing import dec
from underwrite.operators.analysis import spearman
from underwrite.operators.preprocessing import feature_label
from underwrite.operators.quantiles import exact_quantiles
from underwrite.operators.small import attach

UP, DOWN = "aumenta_riesgo", "reduce_riesgo"


def linear_contributions(
    columns: Mapping[str, Column],
    coefficients: Mapping[str, float],
    means: Mapping[str, float],
    deviations: Mapping[str, float],
) -> dict[str, Column]:
    """Log-odds contribution per original variable: scaled column times coefficient, dummies summed."""
    out: dict[str, Column] = {}
    for name, column in columns.items():
        spread = deviations[name] or 1.0
        part = (column - dec(means[name])) / dec(spread) * dec(coefficients[name])
        source = name.split("=", 1)[0]
        out[source] = out[source] + part if source in out else part
    return out


def factor_array(contributions: Mapping[str, Column]) -> Column:
    """All contributions of a row as an array of (feature, impact); of the same type without any."""
    if not contributions:
        return F.array().cast("array<struct<feature:string,impact:double>>")
    return F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("impact")) for n, c in contributions.items()])


def top_factors(factors: Column, labels: dict[str, str], k: int = 3) -> Column:
    """The ``k`` largest by absolute impact with label and direction; no rows are multiplied."""
    keyed = F.transform(
        factors, lambda f: F.struct((-F.abs(f["impact"])).alias("k"), f["feature"].alias("f"), f["impact"].alias("v"))
    )
    return F.transform(
        F.slice(F.sort_array(keyed), 1, k),
        lambda f: F.struct(
            f["f"].alias("feature"),
            feature_label(f["f"], labels).alias("label"),
            F.round(f["v"], 4).alias("impact"),
            F.when(f["v"] > 0, UP).otherwise(DOWN).alias("direction"),
        ),
    )


def long_contributions(df: DataFrame, keep: Sequence[str], contributions: Mapping[str, Column]) -> DataFrame:
    """(keep, feature, contribution)."""
    wide = df.select(*keep, *[c.alias(n) for n, c in contributions.items()])
    return wide.unpivot(list(keep), list(contributions), "feature", "contribution")


def global_importance(df: DataFrame, contributions: Mapping[str, Column], top: int | None = None) -> DataFrame:
    """(feature, mean_abs) from one wide aggregate, strongest first when limited."""
    means = df.agg(*[F.avg(F.abs(c)).alias(n) for n, c in contributions.items()])
    long = means.unpivot([], list(contributions), "feature", "mean_abs")
    return long.orderBy(F.col("mean_abs").desc(), "feature").limit(top) if top else long


def contribution_summary(
    df: DataFrame, contributions: Mapping[str, Column], numeric: Sequence[str], top: int = 12
) -> DataFrame:
    """Strongest variables with the rank correlation between their value and contribution."""
    strongest = global_importance(df, contributions, top)
    shared = [n for n in numeric if n in contributions]
    pairs = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("feature"),
                        F.col(n).cast("double").alias("value"),
                        contributions[n].alias("contribution"),
                    )
                    for n in shared
                ]
            )
        ).alias("r")
    ).select("r.*")
    direction = spearman(pairs, ["feature"], "value", "contribution").select("feature", "spearman")
    # At most ``top`` rows on the left.
    return direction.join(F.broadcast(strongest), "feature", "right").select("feature", "mean_abs", "spearman")


def dependence_points(
    points: DataFrame, feature: str = "feature", value: str = "value", share: float = 0.99
) -> DataFrame:
    """(feature, value, contribution) rows up to the ``share`` quantile of each feature's value."""
    limit = exact_quantiles(points, [feature], value, [share]).select(feature, F.element_at("q", 1).alias("_hi"))
    return attach(points, limit, [feature], ["_hi"]).filter(F.col(value) <= F.col("_hi")).drop("_hi")


def strongest_dependence(df: DataFrame, contributions: Mapping[str, Column], numeric: Sequence[str], top: int = 3, share: float = 0.99) -> DataFrame:
    """(feature, value, contribution) of the ``top`` strongest numeric variables, up to the ``share`` quantile of their value.

    The names of the strongest, at most ``top``, decide which columns are unfolded.
    """
    known = {n: contributions[n] for n in numeric if n in contributions}
    names = [r["feature"] for r in global_importance(df, known, top).collect()]
    pairs = [F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"), known[n].alias("contribution")) for n in names]
    return dependence_points(df.select(F.explode(F.array(*pairs)).alias("r")).select("r.*"), share=share)

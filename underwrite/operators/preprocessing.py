"""Median fill, missing flags and one-hot columns learned on the training rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite.config import DERIVED_FEATURES, MISSING, OTHER, LoanSpec
from underwrite.functions.decisions import traffic_bucket
from underwrite.functions.parsing import dec
from underwrite.operators.quality import category_shares
from underwrite.operators.quantiles import quantiles_of_counts
from underwrite.operators.scan import top_per_key


def long_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, feature, value) with NULLs kept."""
    typed = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(list(keep), list(columns), "feature", "value")


def numeric_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median, null_share) from one frame of value counts, so the rows are read once.

    The median of a column without values is 0, its null share over no rows at all NULL. NaN counts as a value of
    the share, not of the median.
    """
    value = F.when(~F.isnan("value"), F.col("value"))
    counts = long_numeric(df, columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("_known"))
    # on a result of the aggregation the filter stays above it, and both branches share its exchange
    known = counts.filter("_known > 0").select("feature", "value", "n")
    found = quantiles_of_counts(known, ["feature"], "value", [0.5]).select("feature", F.element_at("q", 1).alias("median"))
    empty = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
    shares = counts.groupBy("feature").agg((empty / F.sum("n").cast("double")).alias("null_share"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    joined = names.join(F.broadcast(shares), "feature", "left").join(F.broadcast(found), "feature", "left")
    return joined.select("feature", F.coalesce("median", dec(0)).alias("median"), "null_share")


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median) with 0 for a column without values."""
    return numeric_facts(df, columns).select("feature", "median")


def null_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, null_share): one wide aggregate, no shuffle of rows."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return shares.unpivot([], list(columns), "feature", "null_share")


@dataclass
class Preprocessor:
    """Fitted state is a handful of aggregates; applying it is one generated projection."""

    spec: LoanSpec = field(default_factory=LoanSpec)
    min_category_share: float = 0.005
    min_missing_share: float = 0.001
    medians: dict[str, float] = field(default_factory=dict)
    indicators: list[str] = field(default_factory=list)
    vocabulary: dict[str, list[str]] = field(default_factory=dict)

    @property
    def numeric_columns(self) -> list[str]:
        return self.spec.numeric_names + list(DERIVED_FEATURES)

    def fit(self, features: DataFrame) -> Preprocessor:
        facts = {r["feature"]: r for r in numeric_facts(features, self.numeric_columns).collect()}
        self.medians = {n: facts[n]["median"] for n in self.numeric_columns}
        shares = {n: facts[n]["null_share"] for n in self.spec.numeric_names}
        self.indicators = [n for n, share in shares.items() if share is not None and share >= self.min_missing_share]
        kept = category_shares(features, self.spec.categorical_names, MISSING, self.min_category_share)
        self.vocabulary = {n: [] for n in self.spec.categorical_names}
        for row in kept.select("feature", "value").collect():
            self.vocabulary[row["feature"]].append(row["value"])
        for values in self.vocabulary.values():
            values.sort()
        return self

    def columns(self) -> dict[str, Column]:
        """Model matrix columns in their fixed order."""
        if not self.medians:
            raise RuntimeError("the preprocessor is not fitted")
        out = {n: F.coalesce(F.col(n), dec(self.medians[n])) for n in self.numeric_columns}
        for n in self.indicators:
            out[f"{n}={MISSING}"] = F.col(n).isNull().cast("double")
        for n, values in self.vocabulary.items():
            text = F.coalesce(F.col(n), F.lit(MISSING))
            for value in values:
                out[f"{n}={value}"] = (text == value).cast("double")
            known = text.isin(*values) if values else F.lit(False)
            out[f"{n}={OTHER}"] = (~known).cast("double")
        return out

    def transform(self, features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return features.select(*keep, *[c.alias(n) for n, c in self.columns().items()])


def source_feature(column: Column | str) -> Column:
    """``grade=B`` belongs to ``grade``."""
    return F.substring_index(F.col(column) if isinstance(column, str) else column, "=", 1)


def feature_label(name: Column | str, labels: dict[str, str]) -> Column:
    text = F.col(name) if isinstance(name, str) else name
    entries = [F.lit(v) for pair in labels.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), text), text)


def assign_split(date: Column | str, train_end: str, validation_end: str, test_end: str) -> Column:
    """train < train_end <= validation < validation_end <= test < test_end; later rows have none."""
    at = F.col(date) if isinstance(date, str) else date
    cuts = [F.to_timestamp(F.lit(c)) for c in (train_end, validation_end, test_end)]
    return F.when(at < cuts[0], "train").when(at < cuts[1], "validation").when(at < cuts[2], "test")


class SplitError(ValueError):
    """A period has no labelled rows or one class only."""


def out_of_time_splits(
    df: DataFrame, spec: LoanSpec, train_end: str, validation_end: str, test_end: str
) -> DataFrame:
    """Labelled rows with their ``split``; rows after the test period are left out."""
    labelled = df.filter(F.col(spec.target).isNotNull())
    split = assign_split(spec.date_column, train_end, validation_end, test_end)
    return labelled.withColumn("split", split).filter(F.col("split").isNotNull())


def check_splits(splits: DataFrame, target: str) -> None:
    seen = splits.groupBy("split").agg(F.min(target).alias("low"), F.max(target).alias("high")).collect()
    usable = {r["split"] for r in seen if r["low"] != r["high"]}
    for name in ("train", "validation", "test"):
        if name not in usable:
            raise SplitError(f"period '{name}' has no sufficient labelled rows")


def hash_rank(id_: Column | str, seed: int = 42) -> Column:
    """Position of an id in a fixed random order (60 bits of a digest)."""
    text = F.concat(F.lit(f"{seed}:"), (F.col(id_) if isinstance(id_, str) else id_).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def bounded_sample(df: DataFrame, keys: Sequence[str], id_: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows per key, the same ones on every run: smallest id hashes first."""
    hashed = df.withColumns({"_h": hash_rank(id_, seed), "_i": F.xxhash64(F.col(id_))})
    return top_per_key(hashed, keys, ["_h", "_i"], n).drop("_h", "_i")


def fractional_sample(df: DataFrame, id_: Column | str, fraction: float, salt: str = "sample") -> DataFrame:
    """Rows whose id falls into the first ``fraction`` of the hash range."""
    return df.filter(traffic_bucket(id_, salt) < fraction)

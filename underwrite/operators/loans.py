"""From raw loan text to typed, deduplicated, range-checked feature rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite import config as C
from underwrite.functions.calendar import is_matured, whole_months
from underwrite.functions.parsing import (
    clean_category,
    dec,
    employment_years,
    is_loan_row,
    month_from_text,
    number_from_text,
    score_midpoint,
    status_label,
)
from underwrite.functions.scoring import ratio


# Features whose column combines several raw ones.
COMBINED = ("fico_score", "credit_history_months")


def parse_loans(raw: DataFrame, spec: C.LoanSpec | None = None) -> DataFrame:
    """Canonical loan rows from raw text columns.

    The first projection parses each text once; the second combines parsed values, so that no
    text is parsed again for every use.
    """
    spec = spec or C.LoanSpec()
    if "fico_range_high" not in raw.columns:
        raw = raw.withColumn("fico_range_high", F.lit(None).cast("string"))
    parsed = raw.filter(is_loan_row("loan_amnt")).select(
        F.trim(spec.id_source).alias(spec.id_column),
        month_from_text(spec.date_source).alias(spec.date_column),
        *[
            (employment_years(f.source) if f.name == "emp_length_years" else number_from_text(f.source)).alias(f.name)
            for f in spec.numeric
            if f.name not in COMBINED
        ],
        number_from_text("fico_range_low").alias("_low"),
        number_from_text("fico_range_high").alias("_high"),
        month_from_text("earliest_cr_line").alias("_opened"),
        *[clean_category(f.source, C.CATEGORY_ALIASES.get(f.name)).alias(f.name) for f in spec.categorical],
        F.trim(spec.status_source).alias(spec.status_column),
    )
    combined = {
        "fico_score": score_midpoint(F.col("_low"), F.col("_high")),
        "credit_history_months": whole_months("_opened", spec.date_column).cast("double"),
    }
    label = status_label(spec.status_column, spec.positive, spec.negative)
    matured = is_matured(spec.date_column, "term_months", spec.label_snapshot)
    return parsed.select(
        spec.id_column,
        spec.date_column,
        *[combined[f.name].alias(f.name) if f.name in COMBINED else F.col(f.name) for f in spec.numeric],
        *spec.categorical_names,
        spec.status_column,
        F.when(matured, label).alias(spec.target),
    )


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing input columns: {absent}")


def within_ranges(spec: C.LoanSpec) -> Column:
    """True unless some known numeric value lies outside its allowed range."""
    checks = F.lit(True)
    for f in spec.numeric:
        for bound, ok in ((f.low, F.col(f.name) >= f.low), (f.high, F.col(f.name) <= f.high)):
            if bound is not None:
                checks = checks & F.coalesce(ok, F.lit(True))
    return checks


def clean_loans(df: DataFrame, spec: C.LoanSpec | None = None) -> DataFrame:
    return df.filter(within_ranges(spec or C.LoanSpec()))


def derived_columns() -> dict[str, Column]:
    income = F.col("annual_inc")
    positive = F.when(income < 0, dec(0)).otherwise(income)
    return {
        "loan_to_income": ratio("loan_amnt", income),
        "installment_to_income": ratio(F.col("installment") * 12, income),
        "revol_bal_to_income": ratio("revol_bal", income),
        "open_acc_ratio": ratio("open_acc", "total_acc"),
        "log_annual_inc": F.log1p(positive),
    }


def build_features(df: DataFrame, spec: C.LoanSpec | None = None) -> DataFrame:
    """Add the derived ratios; an absent input column is an error, a bad denominator is NULL."""
    spec = spec or C.LoanSpec()
    require_columns(df, spec.inputs)
    return df.withColumns(derived_columns())


def keep_first(df: DataFrame, key: str | Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first by ``order``, then by every other column.

    A minimum over structs instead of a window: rows of a hot key combine before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    by = [F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)]
    rest = [c for c in df.columns if c not in keys]
    chosen = F.min(F.struct(*by, *rest)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def feature_table(silver: DataFrame, spec: C.LoanSpec | None = None) -> DataFrame:
    """Gold rows: canonical columns, derived ratios and the time they were built."""
    return build_features(silver, spec).withColumn("feature_ts", F.current_timestamp())


def primary_key_violations(df: DataFrame, key: str) -> DataFrame:
    """(rows, null_keys, duplicate_rows) of a column that should identify rows."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
    )

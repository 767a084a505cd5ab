"""Expectation suite over a whole table in one aggregate."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite.config import LoanSpec
from underwrite.functions.parsing import dec

log = logging.getLogger(__name__)

VIOLATION_LIMIT = 0.001
CATEGORY_NULL_LIMIT = 0.01
TARGET_RATE = (0.03, 0.40)


def _check(name: str, column: str, passed: Column, observed: Column, threshold: float, severity: str) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(column).alias("column_name"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        observed.cast("double").alias("observed"),
        dec(threshold).alias("threshold"),
        F.lit(severity).alias("severity"),
    )


def _share(condition: Column) -> Column:
    """Share of all rows that meet a condition; zero for an empty table."""
    return F.coalesce(F.avg(F.when(condition, dec(1)).otherwise(dec(0))), dec(0))


def expectations(df: DataFrame, spec: LoanSpec | None = None, min_rows: int = 1000) -> DataFrame:
    """(name, column_name, passed, observed, threshold, severity): one row per expectation.

    Row-wise shares come from one wide aggregate; ids are first counted per value, so that
    duplicates of a hot id combine before the shuffle.
    """
    spec = spec or LoanSpec()
    # Duplicate share needs the number of different ids, everything else is a conditional mean.
    present = [c for c in spec.leakage if c in df.columns]
    aggregates: dict[str, Column] = {
        "_rows": F.count(F.lit(1)),
        "_nulldate": _share(F.col(spec.date_column).isNull()),
        "_rate": F.avg(spec.target),
    }
    for f in spec.numeric:
        value = F.col(f.name)
        aggregates[f"_null_{f.name}"] = _share(value.isNull() | F.isnan(value))
        aggregates[f"_min_{f.name}"] = _share(value < (f.low if f.low is not None else -1e18))
        aggregates[f"_max_{f.name}"] = _share((value > (f.high if f.high is not None else 1e18)) & ~F.isnan(value))
    for f in spec.categorical:
        aggregates[f"_null_{f.name}"] = _share(F.col(f.name).isNull())
        if f.values:
            aggregates[f"_unknown_{f.name}"] = _share(~F.col(f.name).isin(*f.values))
    stats = df.agg(*[expr.alias(name) for name, expr in aggregates.items()])

    ids = df.groupBy(spec.id_column).agg(F.count(F.lit(1)).alias("n"))
    duplicates = ids.agg(
        F.coalesce((F.sum("n") - F.count(F.lit(1))) / F.sum("n").cast("double"), dec(0)).alias("d")
    ).scalar()

    def at_most(name: str, column: str, key: str, limit: float, severity: str) -> Column:
        return _check(name, column, F.col(key) <= limit, F.col(key), limit, severity)

    checks = [
        _check("row_count_min", "*", F.col("_rows") >= min_rows, F.col("_rows"), min_rows, "error"),
        at_most("unique_id", spec.id_column, "_dup", 0.0, "error"),
        at_most("valid_issue_date", spec.date_column, "_nulldate", 0.0, "error"),
    ]
    for f in spec.numeric:
        checks.append(at_most("null_rate", f.name, f"_null_{f.name}", f.null_limit, "error"))
        for bound in ("min", "max"):
            checks.append(at_most(f"{bound}_value", f.name, f"_{bound}_{f.name}", VIOLATION_LIMIT, "warning"))
    for f in spec.categorical:
        checks.append(at_most("null_rate", f.name, f"_null_{f.name}", CATEGORY_NULL_LIMIT, "error"))
        if f.values:
            checks.append(at_most("known_categories", f.name, f"_unknown_{f.name}", VIOLATION_LIMIT, "warning"))
    low, high = TARGET_RATE
    checks.append(
        _check("default_rate_range", spec.target, F.col("_rate").between(low, high), F.col("_rate"), high, "error")
    )
    leaks = F.lit(len(present))
    checks.append(_check("no_leakage_columns", ",".join(present) or "-", leaks == 0, leaks, 0.0, "error"))
    return stats.withColumn("_dup", duplicates).select(F.inline(F.array(*checks)))


class QualityError(ValueError):
    """An expectation of severity ``error`` failed."""


def assert_quality(results: DataFrame) -> None:
    """Log warnings and raise when an error expectation failed (at most one row per column)."""
    failed = results.filter(~F.col("passed")).collect()
    for row in failed:
        if row["severity"] == "warning":
            log.warning("expectation %s(%s) = %s", row["name"], row["column_name"], row["observed"])
    errors = [r for r in failed if r["severity"] == "error"]
    if errors:
        detail = ", ".join(f"{r['name']}({r['column_name']})={r['observed']}" for r in errors)
        raise QualityError(f"quality gate failed: {detail}")


def quality_log(results: DataFrame, layer: str, run_ts: Column | None = None) -> DataFrame:
    """Suite results in the shape of the quality log table."""
    stamp = run_ts if run_ts is not None else F.current_timestamp()
    return results.select(
        stamp.alias("run_ts"),
        F.lit(layer).alias("layer"),
        "name",
        "column_name",
        "passed",
        "observed",
        "threshold",
        "severity",
    )


def category_shares(df: DataFrame, columns: list[str], missing: str, min_share: float = 0.0) -> DataFrame:
    """(feature, value, n, share) of every text column, NULL counted as ``missing``."""
    long = df.select(*columns).unpivot([], columns, "feature", "value")
    counts = long.groupBy("feature", F.coalesce("value", F.lit(missing)).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # Every row counts once per column: the total comes from the counts, not from a second scan.
    rows = counts.agg((F.sum("n") / F.lit(len(columns))).cast("double").alias("rows")).scalar()
    shares = counts.withColumn("_rows", rows).withColumn("share", F.col("n") / F.col("_rows")).drop("_rows")
    return shares.filter(F.col("share") >= min_share)


def loans_per_year(df: DataFrame, date: str, target: str) -> DataFrame:
    return df.groupBy(F.year(date).alias("year")).agg(
        F.count(F.lit(1)).alias("loans"), F.avg(target).alias("default_rate")
    )

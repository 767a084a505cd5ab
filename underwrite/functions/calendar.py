"""Month arithmetic on timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from underwrite.functions.parsing import col


def month_start(c: Column | str) -> Column:
    return F.date_trunc("month", col(c))


def whole_months(start: Column | str, end: Column | str) -> Column:
    """Calendar months from ``start`` to ``end``, days ignored."""
    a, b = col(start), col(end)
    return (F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a))


def plus_months(c: Column | str, months: int | Column) -> Column:
    """Move a month start by whole months and keep it a timestamp."""
    return F.add_months(month_start(c), months).cast("timestamp")


def is_matured(issue: Column | str, term: Column | str, snapshot: Column | str) -> Column:
    """True once the full term fits between issue and the snapshot; unknown dates are not matured."""
    at = F.to_timestamp(F.lit(snapshot)) if isinstance(snapshot, str) else snapshot
    return F.coalesce(whole_months(issue, at) >= col(term), F.lit(False))


def quarter_label(c: Column | str) -> Column:
    return F.concat(F.year(col(c)).cast("string"), F.lit("Q"), F.quarter(col(c)).cast("string"))


def quarter_phase(c: Column | str, validation: tuple[str, str], test: tuple[str, str]) -> Column:
    """Role of a quarter given the first and last month of the validation and test periods."""
    q = F.date_trunc("quarter", col(c))

    def covers(period: tuple[str, str]) -> Column:
        first, last = (F.date_trunc("quarter", F.to_timestamp(F.lit(month))) for month in period)
        return q.between(first, last)

    return F.when(covers(validation), "validación").when(covers(test), "test").otherwise("producción")


def months_to_process(
    last_processed: Column, production_start: Column, months: int, last_available: Column
) -> Column:
    """Array of the month starts the next incremental run has to score."""
    first = F.coalesce(plus_months(last_processed, 1), month_start(production_start).cast("timestamp"))
    end = month_start(last_available).cast("timestamp")
    candidates = F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda i: plus_months(first, i))
    return F.filter(candidates, lambda m: m <= end)


def monitoring_windows(clock: Column | str, window_months: int, label_delay_months: int) -> Column:
    """Struct with the month bounds of the drift and the labelled window at a clock."""
    now = month_start(clock).cast("timestamp")
    return F.struct(
        now.alias("clock"),
        plus_months(now, 1 - window_months).alias("drift_start"),
        now.alias("drift_end"),
        plus_months(now, 1 - window_months - label_delay_months).alias("label_start"),
        plus_months(now, -label_delay_months).alias("label_end"),
    )


def moving_split_dates(as_of: Column | str, label_delay_months: int) -> Column:
    """Cut dates whose test period is the last six labelled months at ``as_of``."""
    end = plus_months(as_of, 1 - label_delay_months)
    return F.struct(
        plus_months(end, -12).alias("train_end"),
        plus_months(end, -6).alias("validation_end"),
        end.alias("test_end"),
    )

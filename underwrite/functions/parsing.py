"""Columns that turn raw loan text into typed values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from underwrite.config import EMPLOYMENT_YEARS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dec(value: float) -> Column:
    """A DOUBLE literal (SQL literals with a point would be DECIMAL)."""
    return F.lit(float(value))


def number_from_text(c: Column | str) -> Column:
    """Digits, dots and minus signs only; anything that is then no number becomes NULL."""
    return F.regexp_replace(col(c), r"[^0-9.\-]", "").try_cast("double")


def month_from_text(c: Column | str) -> Column:
    """``Dec-2015`` to the first instant of that month, NULL when it is no such text."""
    return F.try_to_timestamp(F.trim(col(c)), F.lit("MMM-yyyy"))


def is_loan_row(c: Column | str) -> Column:
    """False for the footer lines of the file, whose amount is no number."""
    return col(c).try_cast("double").isNotNull()


def lookup(mapping: Mapping[str, object], c: Column | str) -> Column:
    """Value of a small fixed mapping, NULL for unknown keys."""
    entries: list[Column] = []
    for key, value in mapping.items():
        entries += [F.lit(key), F.lit(value)]
    return F.try_element_at(F.create_map(*entries), col(c))


def employment_years(c: Column | str) -> Column:
    return lookup(EMPLOYMENT_YEARS, F.trim(col(c)))


def score_midpoint(low: Column, high: Column) -> Column:
    return (low + F.coalesce(high, low)) / dec(2)


def clean_category(c: Column | str, aliases: Mapping[str, str] | None = None) -> Column:
    text = F.trim(col(c))
    return F.coalesce(lookup(aliases, text), text) if aliases else text


def status_label(c: Column | str, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """1.0 defaulted, 0.0 repaid, NULL without a final outcome."""
    text = F.trim(col(c))
    return F.when(text.isin(*positive), dec(1)).when(text.isin(*negative), dec(0))


def null_if_not_finite(c: Column | str) -> Column:
    value = col(c)
    infinite = value.isin(float("inf"), float("-inf"))
    return F.when(~F.isnan(value) & ~infinite, value)


def as_number(c: Column | str) -> Column:
    return col(c).try_cast("double")

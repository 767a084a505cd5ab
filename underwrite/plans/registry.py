"""Name, plan and SQL counterpart of every registered query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underwrite.plans.doubles import DOUBLE_COLUMNS

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    """``sql`` is the counterpart as written; ``rounded_sql`` is what the driver compares."""

    name: str
    plan: Plan
    sql: str | None = None
    digits: int = 6

    @property
    def rounded_sql(self) -> str | None:
        names = DOUBLE_COLUMNS.get(self.name, "").split()
        if not self.sql or not names:
            return self.sql
        parts = ", ".join(f'round("{n}", {self.digits}) + 0.0e0 as "{n}"' for n in names)
        return f"select * replace ({parts}) from ({self.sql})"


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None, digits: int = 6) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, plan, sql, digits)
        return plan

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that engines that add in another order agree."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )

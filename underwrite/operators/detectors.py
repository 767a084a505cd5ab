"""Sequential change detectors over an ordered table.

Both detectors read every row in order. They run as stacked ordered scans: running sums give the
running mean, a running minimum gives the best level so far, and the first row past a limit is an
aggregate. No task sees more than one range of the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite.config import MonitoringRules
from underwrite.functions.parsing import col, dec
from underwrite.operators.scan import CELL, dealt_ranges, running_min, running_total
from underwrite.operators.small import join_keys


def ordered_rows(df: DataFrame, value: Column | str, order: Sequence[Column | str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, o0, o1, x) with timestamps as microseconds and the range of each row; a NULL key is a stream of its own."""
    columns = []
    types = dict(df.select(*[col(c).alias(f"o{i}") for i, c in enumerate(order)]).dtypes)
    for i, c in enumerate(order):
        expr = col(c)
        if types[f"o{i}"].startswith("timestamp"):
            expr = F.unix_micros(expr.cast("timestamp"))
        columns.append(expr.alias(f"o{i}"))
    rows = df.select(*keys, *columns, col(value).cast("double").alias("x"))
    return dealt_ranges(rows.filter(F.col("x").isNotNull()), [f"o{i}" for i in range(len(order))], keys)


def _carried(counted: DataFrame, keys: Sequence[str], carried: DataFrame | None, columns: dict[str, str]) -> DataFrame:
    """The key's earlier state next to every row, under an underscore; NULL for keys and tables without one."""
    if carried is None:
        return counted.withColumns({f"_{n}": F.lit(None).cast(kind) for n, kind in columns.items()})
    held = carried.select(*keys, *[F.col(n).cast(kind).alias(f"_{n}") for n, kind in columns.items()])
    return join_keys(counted, held, keys, how="left")


#: What a stream carries over: rows, errors, and the lowest level with its position and deviation.
DDM_STATE = {"n": "bigint", "hits": "double", "low": "struct<level:double,at:bigint,sd:double>"}
#: Rows, sum, cumulated deviation and its lowest value.
PAGE_HINKLEY_STATE = {"n": "bigint", "total": "double", "cum": "double", "low": "double"}


def ddm_rows(
    df: DataFrame,
    error: Column | str,
    order: Sequence[Column | str],
    keys: Sequence[str] = (),
    rules: MonitoringRules | None = None,
    carried: DataFrame | None = None,
) -> DataFrame:
    """(keys, n, hits, level, sd, low, active) of every row, continuing the ``carried`` state of each key."""
    rules = rules or MonitoringRules()
    names = [f"o{i}" for i in range(len(order))]
    counted = running_total(ordered_rows(df, error, order, keys), keys, names, {"n": F.lit(1).cast("bigint"), "hits": F.col("x")})
    counted = _carried(counted, keys, carried, DDM_STATE)
    n, hits = F.col("n") + F.coalesce("_n", F.lit(0)), F.col("hits") + F.coalesce("_hits", dec(0))
    counted = counted.select(*keys, *names, CELL, n.alias("n"), hits.alias("hits"), F.col("_low"))
    p = F.col("hits") / F.col("n")
    levels = counted.withColumn("p", p).withColumn("sd", F.sqrt(F.greatest(F.col("p") * (dec(1) - F.col("p")), dec(0)) / F.col("n")))
    active = (F.col("n") >= rules.ddm_min_n) & (F.col("sd") > 0)
    # Ordered by level, then by position: the earliest of equal minima stays.
    best = F.when(active, F.struct((F.col("p") + F.col("sd")).alias("level"), F.col("n").alias("at"), F.col("sd")))
    walked = running_min(levels, keys, names, {"best": best})
    return walked.select(*keys, "n", "hits", (F.col("p") + F.col("sd")).alias("level"), "sd", F.least("best", "_low").alias("low"), active.alias("active"))


def ddm(
    df: DataFrame,
    error: Column | str,
    order: Sequence[Column | str],
    keys: Sequence[str] = (),
    rules: MonitoringRules | None = None,
) -> DataFrame:
    """(keys, state, index, min_p_plus_s) of the drift detection method on a 0/1 stream.

    ``index`` counts from 0. The first drift ends the stream: a warning only counts before it, and
    the reported minimum is the one known at that row.
    """
    found = ddm_summary(ddm_rows(df, error, order, keys, rules), keys, rules)
    drifted = F.col("d").isNotNull()
    return found.select(
        *keys,
        F.when(drifted, "drift").when(F.col("w").isNotNull(), "warning").otherwise("estable").alias("state"),
        F.coalesce(F.col("d.i"), F.col("w.i")).alias("index"),
        F.when(drifted, F.col("d.level")).otherwise(F.col("end.low.level")).alias("min_p_plus_s"),
    )


def ddm_summary(walked: DataFrame, keys: Sequence[str], rules: MonitoringRules | None = None) -> DataFrame:
    """(keys, d, w, end): first drift, first warning (position and lowest level there), and the last row's state."""
    rules = rules or MonitoringRules()

    def first_past(times: float) -> Column:
        # low.level is p_min + s_min, so the limit p_min + times * s_min lies times - 1 deviations above it.
        crossed = F.col("active") & (F.col("level") > F.col("low.level") + F.col("low.sd") * dec(times - 1))
        at = F.when(crossed, F.col("n"))
        return F.when(F.min(at).isNotNull(), F.struct((F.min(at) - 1).alias("i"), F.min_by("low.level", at).alias("level")))

    # Numbers only: a minimum of structs would sort every row of a task before it aggregates.
    low = F.struct(*[F.max_by(f"low.{name}", "n").alias(name) for name in ("level", "at", "sd")])
    low = F.when(F.max_by("low.level", "n").isNotNull(), low)
    return walked.groupBy(*keys).agg(
        first_past(rules.ddm_drift_level).alias("d"), first_past(rules.ddm_warning_level).alias("w"),
        F.struct(F.max("n").alias("n"), F.max_by("hits", "n").alias("hits"), low.alias("low")).alias("end"),
    )


def page_hinkley_rows(
    df: DataFrame,
    value: Column | str,
    order: Sequence[Column | str],
    keys: Sequence[str] = (),
    rules: MonitoringRules | None = None,
    carried: DataFrame | None = None,
) -> DataFrame:
    """(keys, n, total, cum, low, statistic) of every row, continuing the ``carried`` state of each key."""
    rules = rules or MonitoringRules()
    names = [f"o{i}" for i in range(len(order))]
    summed = running_total(ordered_rows(df, value, order, keys), keys, names, {"n": F.lit(1).cast("bigint"), "total": F.col("x")})
    summed = _carried(summed, keys, carried, PAGE_HINKLEY_STATE)
    n, total = F.col("n") + F.coalesce("_n", F.lit(0)), F.col("total") + F.coalesce("_total", dec(0))
    deviation = F.col("x") - F.col("total") / F.col("n") - dec(rules.page_hinkley_delta)
    summed = summed.withColumns({"n": n, "total": total}).withColumn("dev", deviation)
    climbed = running_total(summed, keys, names, {"cum": F.col("dev")}).withColumn("cum", F.col("cum") + F.coalesce("_cum", dec(0)))
    walked = running_min(climbed, keys, names, {"lowest": F.col("cum")})
    low = F.least(F.col("lowest"), F.coalesce("_low", dec(0)))
    return walked.select(*keys, "n", "total", "cum", low.alias("low"), (F.col("cum") - low).alias("statistic"))


def page_hinkley_summary(walked: DataFrame, keys: Sequence[str], rules: MonitoringRules | None = None) -> DataFrame:
    """(keys, h, last, end): first row over the limit, the last statistic, and the last row's state."""
    rules = rules or MonitoringRules()
    at = F.when(F.col("statistic") > rules.page_hinkley_lambda, F.col("n"))
    hit = F.when(F.min(at).isNotNull(), F.struct((F.min(at) - 1).alias("i"), F.min_by("statistic", at).alias("s")))
    end = F.struct(F.max("n").alias("n"), *[F.max_by(name, "n").alias(name) for name in ("total", "cum", "low")])
    return walked.groupBy(*keys).agg(
        hit.alias("h"), F.max_by("statistic", "n").alias("last"), end.alias("end")
    )


def page_hinkley(
    df: DataFrame,
    value: Column | str,
    order: Sequence[Column | str],
    keys: Sequence[str] = (),
    rules: MonitoringRules | None = None,
) -> DataFrame:
    """(keys, drift, index, statistic): first sustained rise of the mean, else the last statistic."""
    found = page_hinkley_summary(page_hinkley_rows(df, value, order, keys, rules), keys, rules)
    return found.select(
        *keys,
        F.col("h").isNotNull().alias("drift"),
        F.col("h.i").alias("index"),
        F.coalesce(F.col("h.s"), F.col("last")).alias("statistic"),
    )

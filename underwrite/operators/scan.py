"""Ordered scans over a whole table without a single-task window.

A global ``ORDER BY`` window runs in one task, and a window partitioned by a key runs one task
per key, which fails when a key holds a third of the rows. The scan here works in two levels:

1. quantiles of the order column cut the rows into ranges of equal size. The cut points come
   from a scalar subquery, so the range of a row depends on its values only and recomputed
   tasks agree with the first run;
2. a window inside each (key, range) gives local running values, the last row of every range
   gives the range totals, and a second window over those few totals gives the offsets.

A value that alone fills more than one range falls exactly on a cut point; such ties get their
own range, which the second order column (an id) cuts further.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from underwrite.session import parallelism

RANGE = "_range"
CELL = "_cell"
COARSE = 64
#: Rows that a range of a large table holds about; a task sorts a few ranges.
RANGE_ROWS = 500_000


def _all_columns(df: DataFrame) -> Column:
    """Always true, but it needs every column: a side branch that keeps this filter has the same
    exchange as the main branch, so Spark computes the exchange once and reuses it."""
    return F.xxhash64(*[n for n, kind in df.dtypes if "map<" not in kind]) >= F.lit(-(2**63))


def cut_points(df: DataFrame, column: str, ranges: int, grouped: bool = False) -> Column:
    """Scalar subquery with ``ranges - 1`` quantiles of a numeric column.

    ``grouped`` says that ``df`` is the output of a ``groupBy``. An always-true filter then keeps
    every column of ``df`` in the subquery, so that Spark reuses the exchange the main branch
    already computes; otherwise the subquery reads the order column alone.
    """
    shares = [i / ranges for i in range(1, ranges)]
    if grouped:
        df = df.filter(_all_columns(df))
    return df.select(F.percentile_approx(column, shares, max(10_000, 20 * ranges))).scalar()


def _below(edges: Column, count: int, x: Column) -> Column:
    """How many of the ascending edges are less than ``x``: coarse steps, then one slice."""
    if count <= COARSE:
        return F.size(F.filter(edges, lambda e: e < x))
    steps = F.transform(F.sequence(F.lit(COARSE), F.lit(count), F.lit(COARSE)), lambda i: F.element_at(edges, i))
    full = F.size(F.filter(steps, lambda e: e < x)) * COARSE
    return full + F.size(F.filter(F.slice(edges, full + 1, COARSE), lambda e: e < x))


def with_range(
    df: DataFrame, order: Sequence[str], ranges: int | None = None, grouped: bool = False
) -> DataFrame:
    """Add a bigint range number that rises with ``order`` (one or two numeric columns)."""
    n = ranges or parallelism(df.sparkSession)
    out = df.withColumn("_cuts0", cut_points(df, order[0], n, grouped))
    if len(order) > 1:
        out = out.withColumn("_cuts1", cut_points(df, order[1], n, grouped))
    first = F.col(order[0])
    tied = F.array_contains("_cuts0", first)
    position = (_below(F.col("_cuts0"), n - 1, first) * 2 + tied.cast("int")).cast("bigint")
    if len(order) > 1:
        inner = F.when(tied, _below(F.col("_cuts1"), n - 1, F.col(order[1]))).otherwise(F.lit(0))
        position = position * (n + 1) + inner
    return out.withColumn(RANGE, F.coalesce(position, F.lit(-1).cast("bigint"))).drop("_cuts0", "_cuts1")


def dealt_ranges(df: DataFrame, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """:func:`with_range` with ranges that stay small on any table: beyond ``RANGE_ROWS`` rows for every partition of
    the session, their number follows the rows, and so does the number of tasks that sort them."""
    base = parallelism(df.sparkSession)
    ranges = max(base, -(-df.count() // RANGE_ROWS))
    ranged = with_range(df, order, ranges)
    # Keys and range as one column that is never NULL: windows and offset joins of a scan then share one exchange.
    ranged = ranged.withColumn(CELL, F.struct(*keys, RANGE)).drop(RANGE)
    return ranged.repartition(ranges, CELL) if ranges > base else ranged


def _attach_offsets(local: DataFrame, keys: Sequence[str], offsets: DataFrame) -> DataFrame:
    """Left join of the few range offsets; AQE broadcasts them when their measured size allows."""
    if CELL in local.columns:
        match = F.col(f"l.{CELL}") == F.col(f"o.{CELL}")
    else:
        match = F.col(f"l.{RANGE}") == F.col(f"o.{RANGE}")
        for key in keys:  # a NULL key is a key of its own
            match &= F.col(f"l.`{key}`").eqNullSafe(F.col(f"o.`{key}`"))
    added = [F.col(f"o.`{c}`") for c in offsets.columns if c not in (*keys, RANGE, CELL)]
    return local.alias("l").join(offsets.alias("o"), match, "left").select("l.*", *added)


def _cell(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """The columns that name a range of a key: the one of :func:`dealt_ranges`, else the keys and the range."""
    return [CELL] if CELL in df.columns else [*keys, RANGE]


def _position(df: DataFrame) -> Column:
    return F.col(f"{CELL}.{RANGE}") if CELL in df.columns else F.col(RANGE)


def _local_window(cell: Sequence[str], order: Sequence[str], descending: bool = False):
    spec = W.partitionBy(*cell)
    return spec.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in order])


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums of ``values`` over ``order`` per key.

    ``df`` needs the range column of :func:`with_range`; NULL keys form one group. ``totals`` optionally
    names, per value, an extra column with the sum over the whole key.
    """
    totals = totals or {}
    ahead = _local_window(_cell(df, keys), order)
    rows = ahead.rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumns({n: F.sum(v).over(rows) for n, v in values.items()})
    local = local.withColumn("_last", F.lead(F.lit(True)).over(ahead).isNull())

    ends = local.filter(F.col("_last") & _all_columns(df))
    before = W.partitionBy(*keys).orderBy(_position(df)).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    # Every range of a key repeats its totals, so the offset frame has one row per (key, range).
    shifts = [F.sum(n).over(before).alias(f"_off_{n}") for n in values]
    sums = [F.sum(n).over(whole).alias(t) for n, t in totals.items()]
    offsets = ends.select(*dict.fromkeys([*keys, *_cell(df, keys)]), *shifts, *sums)

    joined = _attach_offsets(local.drop("_last"), keys, offsets)
    shifted = {n: F.col(n) + F.coalesce(F.col(f"_off_{n}"), F.lit(0)) for n in values}
    return joined.withColumns(shifted).drop(*[f"_off_{n}" for n in values])


def running_min(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Inclusive running minimum of ``values`` (any orderable type) over ``order`` per key."""
    ahead = _local_window(_cell(df, keys), order)
    rows = ahead.rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumns({n: F.min(v).over(rows) for n, v in values.items()})
    local = local.withColumn("_last", F.lead(F.lit(True)).over(ahead).isNull())
    before = W.partitionBy(*keys).orderBy(_position(df)).rowsBetween(W.unboundedPreceding, -1)
    offsets = local.filter(F.col("_last") & _all_columns(df)).select(
        *dict.fromkeys([*keys, *_cell(df, keys)]), *[F.min(n).over(before).alias(f"_off_{n}") for n in values]
    )
    joined = _attach_offsets(local.drop("_last"), keys, offsets)
    return joined.withColumns({n: F.least(F.col(n), F.col(f"_off_{n}")) for n in values}).drop(
        *[f"_off_{n}" for n in values]
    )


def running_xor(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Inclusive running exclusive or of the integers ``values`` over ``order`` per key; needs the range column."""
    rows = _local_window([*keys, RANGE], order).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumns({n: F.bit_xor(v).over(rows) for n, v in values.items()})
    totals = df.groupBy(*keys, RANGE).agg(*[F.bit_xor(v).alias(n) for n, v in values.items()])
    before = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, RANGE, *[F.bit_xor(n).over(before).alias(f"_off_{n}") for n in values])
    joined = _attach_offsets(local, keys, offsets)
    shifted = {n: F.col(n).bitwiseXOR(F.coalesce(F.col(f"_off_{n}"), F.lit(0))) for n in values}
    return joined.withColumns(shifted).drop(*[f"_off_{n}" for n in values])


def next_value(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """The value of ``column`` that follows in its order per key, NULL after the last; needs the range column."""
    local = df.withColumn(name, F.lead(column).over(_local_window([*keys, RANGE], [column])))
    starts = df.groupBy(*keys, RANGE).agg(F.min(column).alias("_start"))
    after = F.lead("_start").over(W.partitionBy(*keys).orderBy(RANGE)).alias("_next")
    joined = _attach_offsets(local, keys, starts.select(*keys, RANGE, after))
    return joined.withColumn(name, F.coalesce(name, "_next")).drop("_next")


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], number: str = "row_number", total: str = "row_count"
) -> DataFrame:
    """1-based position of each row per key plus the size of the key, by ``order`` ascending."""
    ranged = with_range(df, order)
    out = running_total(ranged, keys, order, {number: F.lit(1).cast("bigint")}, {number: total})
    return out.drop(RANGE)


def ntile_of(position: Column, total: Column, tiles: int) -> Column:
    """Tile of a row position; the first ``total % tiles`` tiles take one row more."""
    small = F.floor(total / tiles)
    larger = total % tiles
    boundary = larger * (small + 1)
    early = F.floor((position - 1) / (small + 1)) + 1
    late = larger + F.floor(F.try_divide(position - 1 - boundary, small)) + 1
    return F.when(position <= boundary, early).otherwise(late).cast("int")


def ntile(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], tiles: int = 10, name: str = "tile"
) -> DataFrame:
    """SQL ``ntile`` over a global order."""
    numbered = row_numbers(df, keys, order, "_pos", "_size")
    return numbered.withColumn(name, ntile_of(F.col("_pos"), F.col("_size"), tiles)).drop("_pos", "_size")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of every key; exact also when one key holds most rows."""
    return row_numbers(df, keys, order, "_pos", "_size").filter(F.col("_pos") <= n).drop("_pos", "_size")


def following(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``value`` of the row that comes next in ``order`` per key, NULL after the last; needs the range column."""
    local = df.withColumn(name, F.lead(value).over(_local_window([*keys, RANGE], order)))
    starts = df.groupBy(*keys, RANGE).agg(F.min(F.struct(*order, value.alias("_v"))).alias("_start"))
    after = F.lead("_start._v").over(W.partitionBy(*keys).orderBy(RANGE)).alias("_next")
    joined = _attach_offsets(local, keys, starts.select(*keys, RANGE, after))
    return joined.withColumn(name, F.coalesce(name, "_next")).drop("_next")

"""Percentile bootstrap of ranking metrics, all replicates in two passes over score ranges, inside the JVM.

Rows collapse to label counts per distinct score, and the counts are cut into score ranges of equal size. A
replicate draws a Poisson weight for each (score, class) count, because the sum of c independent Poisson(1) row
weights is Poisson(c). A draw is a function of seed, keys, score, class and replicate alone, so both passes, repeated
tasks and other engines agree on it and nothing is carried along: the score's digest gives two numbers, the
replicate's digest the multipliers of a linear hash of them modulo a prime, and that uniform number is inverted.

The first pass adds up the weights of each (range, replicate); their running sums come back to the ranges as one
array per range. Only then a range is unfolded by replicates, inside its task: neither pass shuffles a row more
than once, and replicates meet again as sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from underwrite.functions.parsing import dec
from underwrite.operators.counts import score_counts
from underwrite.operators.scan import RANGE, with_range

PRIME = (1 << 31) - 1
#: Counts up to this are drawn by inverting the distribution, larger ones by its normal expansion.
SMALL = 12
#: Steps of the inverted distribution: beyond it lies less than 1e-10 of Poisson(SMALL).
STEPS = 44
#: The same for a single row, the commonest count.
STEPS_OF_ONE = 14
UNIFORMS = 4


@dataclass(frozen=True)
class Metric:
    """Part of a metric one score contributes, and how parts combine (``sum`` or ``max``).

    ``part(score, pos, neg, pos_cum, neg_cum, pos_all, neg_all)`` gets columns: the weights at a score, those up to
    and with it, and the total weight of each class.
    """

    part: Callable[..., Column]
    combine: str = "sum"


def standard_metrics() -> dict[str, Metric]:
    """AUC, separation and average precision."""

    def auc(score, pos, neg, pos_cum, neg_cum, pos_all, neg_all):
        return pos * (neg_cum - neg / dec(2)) / (pos_all * neg_all)

    def ks(score, pos, neg, pos_cum, neg_cum, pos_all, neg_all):
        return F.abs(pos_cum / pos_all - neg_cum / neg_all)

    def pr_auc(score, pos, neg, pos_cum, neg_cum, pos_all, neg_all):
        hits, alarms = pos_all - pos_cum + pos, neg_all - neg_cum + neg
        return pos / pos_all * F.coalesce(F.try_divide(hits, hits + alarms), dec(0))

    return {"roc_auc": Metric(auc), "ks": Metric(ks, "max"), "pr_auc": Metric(pr_auc)}


def _hex(digest: Column, at: int) -> Column:
    """28 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, at, 7), 16, 10).cast("bigint")


def replicate_numbers(spark: SparkSession, n: int, seed: int) -> Column:
    """Scalar subquery: multipliers and shift of every uniform number, one struct per replicate from 0 (the data itself)."""
    rows = spark.range(0, n + 1, 1, 1).select(F.col("id").cast("int").alias("replicate"))
    for j in range(UNIFORMS):
        digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("replicate").cast("string"), F.lit(f":{j}")).cast("binary"))
        rows = rows.withColumns({f"{name}{j}": _hex(digest, at) for name, at in (("a", 1), ("b", 8), ("c", 15))})
    return rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("d")).scalar()


def with_digest(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two 28-bit numbers of each (keys, score)."""
    s = F.col("score")
    fine = F.when(F.abs(s) < 1000, s * dec(2**52)).otherwise(s).cast("bigint")
    parts = [*[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("~")) for k in keys], fine.cast("string")]
    digest = counts.withColumn("_md5", F.md5(F.concat_ws(":", *parts).cast("binary")))
    return digest.withColumns({"_h1": _hex(F.col("_md5"), 1), "_h2": _hex(F.col("_md5"), 8)}).drop("_md5")


# The draws are written as SQL text: one parsed expression instead of hundreds of column objects.
def poisson_steps(count: str) -> Column:
    """Cumulative probabilities of Poisson(count) for 0, 1, ...; NULL for counts that need none."""
    term = f"a.term * {count} / k"
    step = f"struct({term} as term, concat(a.upto, array(element_at(a.upto, -1) + {term})) as upto)"
    start = f"struct(exp(-cast({count} as double)) as term, array(exp(-cast({count} as double))) as upto)"
    return F.expr(f"case when {count} > 1 and {count} <= {SMALL} then aggregate(sequence(1, {STEPS - 1}), {start}, (a, k) -> {step}).upto end")


def uniform(j: int) -> str:
    """The j-th uniform number of a (score, replicate) row, strictly between 0 and 1."""
    return f"(((_h1 * _d.a{j} % {PRIME} + _h2 * _d.b{j} % {PRIME} + _d.c{j}) % {PRIME} + 0.5D) / {PRIME}D)"


def poisson_of_one(u: str) -> str:
    """Poisson(1) weight of a uniform number by comparisons alone."""
    term = upto = math.exp(-1.0)
    parts = [f"cast({u} >= {upto!r}D as int)"]
    for k in range(1, STEPS_OF_ONE):
        term /= k
        upto += term
        parts.append(f"cast({u} >= {upto!r}D as int)")
    return f"cast({' + '.join(parts)} as double)"


def poisson(count: str, steps: str, u: str, z: str) -> Column:
    """Poisson weight of ``count`` rows from a uniform and, for large counts, a normal number."""
    root = f"sqrt(cast({count} as double))"
    wide = f"floor({count} + {root} * {z} + ({z} * {z} - 1) / 6D + ({z} - {z} * {z} * {z}) / (72D * {root}) + 0.5D)"
    small = f"cast(size(filter({steps}, e -> e <= {u})) as double)"
    return F.expr(
        f"case when _d.replicate = 0 then cast({count} as double) when {count} = 0 then 0D when {count} = 1 then {poisson_of_one(u)} "
        f"when {count} <= {SMALL} then {small} else greatest(cast({wide} as double), 0D) end"
    )


def _drawn(rows: DataFrame) -> DataFrame:
    """Weights w_pos, w_neg of rows unfolded to (score, replicate), which have ``_d``."""
    drawn = rows.withColumns({f"_u{j}": F.expr(uniform(j)) for j in range(UNIFORMS)})
    drawn = drawn.withColumns({f"_z{j}": F.expr(f"sqrt(-2D * ln(_u{j})) * cos(2D * pi() * _u{j + 1})") for j in (0, 2)})
    weights = {f"w_{side}": poisson(side, f"_s_{side}", f"_u{j}", f"_z{j}") for j, side in ((0, "pos"), (2, "neg"))}
    return drawn.withColumns(weights).withColumn("replicate", F.col("_d.replicate"))


def replicate_metrics(
    df: DataFrame,
    label: Column | str,
    score: Column | str,
    metrics: dict[str, Metric],
    n: int = 300,
    keys: Sequence[str] = (),
    seed: int = 42,
) -> DataFrame:
    """(keys, replicate, one column per metric); replicates that lost a class are left out."""
    counts = with_digest(with_range(score_counts(df, label, score, keys), ["score"], grouped=True), keys)
    counts = counts.withColumns({f"_s_{side}": poisson_steps(side) for side in ("pos", "neg")})
    by = [*keys, RANGE]
    everyone = replicate_numbers(df.sparkSession, n, seed)
    sums = _drawn(counts.withColumn("_d", everyone).withColumn("_d", F.explode("_d"))).groupBy(*by, "replicate").agg(
        F.sum("w_pos").alias("pos_here"), F.sum("w_neg").alias("neg_here")
    )
    one = W.partitionBy(*keys, "replicate")
    below = one.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    shifted = sums.select(
        *by, "replicate",
        F.coalesce(F.sum("pos_here").over(below), dec(0)).alias("pos_below"), F.coalesce(F.sum("neg_here").over(below), dec(0)).alias("neg_below"),
        F.sum("pos_here").over(one).alias("pos_all"), F.sum("neg_here").over(one).alias("neg_all"),
    )
    kept = shifted.filter((F.col("pos_all") > 0) & (F.col("neg_all") > 0))
    # n + 1 short structs per range: what a range needs to go on by itself.
    packed = kept.groupBy(*by).agg(F.collect_list(F.struct("replicate", "pos_below", "neg_below", "pos_all", "neg_all")).alias("_o"))
    match = F.col(f"l.{RANGE}") == F.col(f"o.{RANGE}")
    for key in keys:  # a NULL key is a key of its own
        match &= F.col(f"l.`{key}`").eqNullSafe(F.col(f"o.`{key}`"))
    both = counts.alias("l").join(packed.alias("o"), match).select("l.*", F.explode("o._o").alias("_o"))
    drawn = _drawn(both.withColumn("_d", everyone).withColumn("_d", F.element_at("_d", F.col("_o.replicate") + 1)))
    here = W.partitionBy(*by, "replicate").orderBy("score").rowsBetween(W.unboundedPreceding, 0)
    ranked = drawn.withColumns({"pos_cum": F.col("_o.pos_below") + F.sum("w_pos").over(here), "neg_cum": F.col("_o.neg_below") + F.sum("w_neg").over(here)})
    args = [F.col(c) for c in ("score", "w_pos", "w_neg", "pos_cum", "neg_cum", "_o.pos_all", "_o.neg_all")]
    combined = [(F.max if m.combine == "max" else F.sum)(m.part(*args)).alias(name) for name, m in metrics.items()]
    return ranked.groupBy(*keys, "replicate").agg(*combined)


def bootstrap_interval(
    df: DataFrame,
    label: Column | str,
    score: Column | str,
    metrics: Sequence[str] = ("roc_auc", "ks", "pr_auc"),
    n: int = 300,
    alpha: float = 0.05,
    keys: Sequence[str] = (),
    seed: int = 42,
    custom: dict[str, Metric] | None = None,
) -> DataFrame:
    """(keys, metric, estimate, ci_low, ci_high, n_boot). ``custom`` adds the caller's own metrics."""
    known = standard_metrics()
    chosen = {m: known[m] for m in metrics} | (custom or {})
    values = replicate_metrics(df, label, score, chosen, n, keys, seed)
    long = values.unpivot([*keys, "replicate"], list(chosen), "metric", "value")
    by = [*keys, "metric"]
    # At most n rows per (key, metric): small enough for the built-in exact percentile.
    drawn = F.when(F.col("replicate") > 0, F.col("value"))
    return long.groupBy(*by).agg(
        F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("estimate"),
        F.percentile(drawn, alpha / 2).alias("ci_low"),
        F.percentile(drawn, 1 - alpha / 2).alias("ci_high"),
        F.count(drawn).alias("n_boot"),
    )


def auc_difference(
    df: DataFrame,
    label: Column | str,
    score: Column | str,
    arm: str,
    first: str,
    second: str,
    n: int = 500,
    keys: Sequence[str] = (),
    seed: int = 42,
) -> DataFrame:
    """(keys, auc_diff, ci_low, ci_high, p_value) of AUC(second) - AUC(first), arms drawn independently."""
    rows = df.filter(F.col(arm).isin(first, second))
    only = {"auc": standard_metrics()["roc_auc"]}
    values = replicate_metrics(rows, label, score, only, n, [*keys, arm], seed)
    paired = values.groupBy(*keys, "replicate").agg(
        F.max(F.when(F.col(arm) == first, F.col("auc"))).alias("a"),
        F.max(F.when(F.col(arm) == second, F.col("auc"))).alias("b"),
    )
    diffs = paired.select(*keys, "replicate", (F.col("b") - F.col("a")).alias("value"))
    drawn = F.when(F.col("replicate") > 0, F.col("value"))
    return diffs.groupBy(*keys).agg(
        F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("auc_diff"),
        F.percentile(drawn, 0.025).alias("ci_low"),
        F.percentile(drawn, 0.975).alias("ci_high"),
        F.avg((drawn <= 0).cast("double")).alias("p_value"),
    )

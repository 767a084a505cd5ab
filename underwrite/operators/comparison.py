"""Multiplicity control and the parsimonious choice between models (k-row frames)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from underwrite.config import QualityGates, SelectionRules
from underwrite.functions.parsing import col, dec
from underwrite.functions.stats import interpret_difference
from underwrite.operators.delong import auc_table, paired_tests

UNKNOWN_COMPLEXITY = 99


def holm(df: DataFrame, p: str, keys: Sequence[str], tie: str, name: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values inside each family; an impossible p-value fails the query."""
    bad = F.col(p).isNull() | F.isnan(p) | ~F.coalesce(F.col(p).between(0, 1), F.lit(False))
    value = F.when(bad, F.raise_error(F.lit("p-values must lie in [0, 1]")).cast("double")).otherwise(F.col(p))
    order = W.partitionBy(*keys).orderBy("_p", tie)
    ranked = df.withColumn("_p", value).withColumn("_rank", F.row_number().over(order))
    left = F.count(F.lit(1)).over(W.partitionBy(*keys)) - F.col("_rank") + 1
    scaled = ranked.withColumn("_scaled", F.col("_p") * left)
    stepped = F.max("_scaled").over(order.rowsBetween(W.unboundedPreceding, 0))
    return scaled.withColumn(name, F.least(stepped, dec(1))).drop("_p", "_rank", "_scaled")


def pairwise_comparison(
    df: DataFrame,
    label: Column | str,
    scores: Sequence[str],
    keys: Sequence[str] = (),
    rules: SelectionRules | None = None,
) -> DataFrame:
    """Every pair of models with interval, adjusted p-value and a reading."""
    rules = rules or SelectionRules()
    adjusted = holm(paired_tests(df, label, scores, keys), "p_value", keys, "pair")
    reading = interpret_difference(F.col("delta"), F.col("p_holm"), rules.practical_margin, rules.alpha)
    return adjusted.withColumn("interpretation", reading)


def test_report(df: DataFrame, label: Column | str, scores: Sequence[str], rules: SelectionRules | None = None) -> DataFrame:
    """Evidence of the test period in one table: section ``auc`` has every model (a scorecard is one more score) with
    its interval, section ``pair`` every pair with its adjusted p-value and reading. Nothing is decided with it."""
    singles = auc_table(df, label, scores).select(
        F.lit("auc").alias("section"), F.col("model").alias("model_a"), F.col("auc").alias("auc_a"), "ci_low", "ci_high", F.col("n").alias("n_rows")
    )
    pairs = pairwise_comparison(df, label, scores, rules=rules).select(
        F.lit("pair").alias("section"), "model_a", "model_b", "auc_a", "auc_b", "delta", "ci_low", "ci_high", "p_value", "p_holm", "interpretation"
    )
    return singles.unionByName(pairs, allowMissingColumns=True)


def eligible(bench: DataFrame, gates: QualityGates | None = None, gap: str = "val_auc_gap") -> DataFrame:
    """Candidates inside the latency and overfit gates, or all of them when none is."""
    gates = gates or QualityGates()
    inside = (F.col("latency_ms") <= gates.max_latency_ms) & (F.col(gap) <= gates.max_overfit_gap)
    flagged = bench.withColumn("_in", F.coalesce(inside, F.lit(False)))
    anyone = F.max("_in").over(W.partitionBy(F.lit(0)))
    return flagged.withColumn("eligible", F.col("_in") | ~anyone).drop("_in")


def best_by(bench: DataFrame, metric: str, name: str = "algorithm") -> DataFrame:
    """The eligible candidate with the highest metric."""
    return bench.filter("eligible").agg(
        F.max_by(name, metric).alias(name), F.max(metric).alias(metric)
    )


def complexity_of(model: Column | str, complexity: Mapping[str, int]) -> Column:
    chain = F.when(F.lit(False), F.lit(UNKNOWN_COMPLEXITY))
    for key, level in complexity.items():
        chain = chain.when(col(model) == key, F.lit(level))
    return chain.otherwise(F.lit(UNKNOWN_COMPLEXITY))


def select_parsimonious(
    df: DataFrame,
    label: Column | str,
    scores: Sequence[str],
    complexity: Mapping[str, int],
    eligible_models: Sequence[str] | None = None,
    rules: SelectionRules | None = None,
) -> DataFrame:
    """The simplest model that is not worse in both the statistical and the practical sense.

    One row per model: auc, delta_vs_best, p_holm, eligible, retained, complexity, selected.
    """
    rules = rules or SelectionRules()
    allowed = list(scores) if eligible_models is None else [s for s in scores if s in set(eligible_models)]
    if not allowed:
        raise ValueError("no eligible candidate to select from")
    ordered = [(a, b) for a in allowed for b in scores if a != b]
    order_of = F.create_map(*[F.lit(v) for i, s in enumerate(scores) for v in (s, i)])

    aucs = auc_table(df, label, scores).select("model", "auc")
    everyone = W.partitionBy(F.lit(0))
    rank = F.struct(F.col("auc"), -F.element_at(order_of, F.col("model")), F.col("model").alias("m"))
    is_allowed = F.col("model").isin(*allowed)
    table = aucs.withColumn("eligible", is_allowed).withColumn(
        "reference", F.max(F.when(is_allowed, rank)).over(everyone)["m"]
    )
    tests = paired_tests(df, label, scores, pairs=ordered).select(
        F.col("model_a").alias("reference"), F.col("model_b").alias("model"), "delta", "p_value"
    )
    joined = table.join(tests, ["reference", "model"], "left")
    is_reference = F.col("model") == F.col("reference")
    # Holm runs over the eligible challengers only; every other row forms a family of its own.
    family = joined.withColumn("_family", F.col("eligible") & ~is_reference).withColumn(
        "p_value", F.when(F.col("_family"), F.col("p_value")).otherwise(dec(1))
    )
    rows = holm(family, "p_value", ["_family"], "model").select(
        "model",
        "auc",
        F.when(is_reference, dec(0)).otherwise(F.col("delta")).alias("delta_vs_best"),
        F.when(F.col("_family") | is_reference, F.col("p_holm")).alias("p_holm"),
        "eligible",
        "reference",
        complexity_of("model", complexity).alias("complexity"),
    )
    worse = F.coalesce(
        (F.col("p_holm") < rules.alpha) & (F.col("delta_vs_best") >= rules.practical_margin), F.lit(False)
    )
    rows = rows.withColumn("retained", F.col("eligible") & ~worse)
    choice = F.min(F.when(F.col("retained"), F.struct("complexity", (-F.col("auc")).alias("a"), "model"))).over(everyone)
    return rows.withColumn("selected", F.col("model") == choice["model"])


def gate_reasons(
    auc: Column | str, gap: Column | str, brier: Column | str, latency: Column | str, gates: QualityGates | None = None
) -> Column:
    """Texts of the absolute gates a model fails; empty when it passes."""
    g = gates or QualityGates()
    a, d, b, ms = (col(c) for c in (auc, gap, brier, latency))

    def fails(ok: Column, text: Column) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), text)

    return F.array_compact(
        F.array(
            fails(a >= g.min_test_roc_auc, F.format_string(f"AUC test %.4f < {g.min_test_roc_auc}", a)),
            fails(d <= g.max_overfit_gap, F.format_string(f"brecha train-test %.4f > {g.max_overfit_gap}", d)),
            fails(b <= g.max_brier, F.format_string(f"Brier %.4f > {g.max_brier}", b)),
            fails(ms <= g.max_latency_ms, F.format_string(f"latencia %.2fms > {g.max_latency_ms}", ms)),
        )
    )


def choose_final(tuned: DataFrame, bench: DataFrame) -> DataFrame:
    """Tuned model when it passes, else the first benchmark row that does, else the tuned one.

    Both frames carry ``algorithm`` and ``passed``; ``bench`` also its ``position``.
    """
    first = F.min(F.when(F.col("passed"), F.struct("position", "algorithm")))["algorithm"]
    fallback = bench.agg(first.alias("fallback")).scalar()
    return tuned.withColumn("_f", fallback).select(
        F.when(F.col("passed"), F.col("algorithm")).otherwise(F.coalesce(F.col("_f"), F.col("algorithm"))).alias("algorithm"),
        F.when(F.col("passed"), "tuned").when(F.col("_f").isNotNull(), "fallback_default").otherwise("tuned").alias("origin"),
    )


def champion_vs_challenger(challenger: Column, champion: Column, gates: QualityGates | None = None) -> Column:
    """Struct (promote, reason) of an offline validation."""
    g = gates or QualityGates()
    gain = challenger - champion
    absent = champion.isNull() | F.isnan(champion)
    enough = F.coalesce(absent | (gain >= g.min_auc_improvement), F.lit(False))
    signed = F.format_string("%+.4f", gain)
    reason = (
        F.when(absent, F.lit("no existe champion: el primer modelo válido se promueve"))
        .when(enough, F.concat(F.lit("challenger mejora AUC en "), signed))
        .otherwise(F.concat(F.lit("mejora insuficiente ("), signed, F.lit(f" < {g.min_auc_improvement})")))
    )
    return F.struct(enough.alias("promote"), reason.alias("reason"))


def same_data_source(champion: Column, challenger: Column) -> Column:
    """Comparable only if the champion names its source and the challenger has the same (default real)."""
    return F.coalesce(champion == F.coalesce(challenger, F.lit("real")), F.lit(False))


def orient_pairs(pairs: DataFrame, final: str) -> DataFrame:
    """Pairs that contain ``final``, each restated as final minus other."""
    flipped = F.col("model_b") == final
    sign = F.when(flipped, dec(-1)).otherwise(dec(1))
    low, high = F.col("ci_low") * sign, F.col("ci_high") * sign
    return pairs.filter((F.col("model_a") == final) | flipped).select(
        F.lit(final).alias("model_a"),
        F.when(flipped, F.col("model_a")).otherwise(F.col("model_b")).alias("model_b"),
        (F.col("delta") * sign).alias("delta"),
        F.least(low, high).alias("ci_low"),
        F.greatest(low, high).alias("ci_high"),
        "p_holm",
    )


def lineage_problems(tags: Column, required: Sequence[str], version_key: str = "gold_delta_version") -> Column:
    """What is missing before a version can be traced to code, data and cut dates."""
    entries = F.coalesce(tags, F.create_map().cast("map<string,string>"))

    def text(key: str | Column) -> Column:
        k = F.lit(key) if isinstance(key, str) else key
        return F.trim(F.coalesce(F.try_element_at(entries, k), F.lit("")))

    blank = F.filter(F.array(*[F.lit(k) for k in required]), lambda k: text(k) == "")
    absent = F.transform(blank, lambda k: F.concat(F.lit("falta el tag '"), k, F.lit("'")))
    unresolved = F.when(text(version_key) == "unknown", F.array(F.lit(f"'{version_key}' sin resolver (DESCRIBE HISTORY falló)")))
    return F.concat(absent, F.coalesce(unresolved, F.array().cast("array<string>")))

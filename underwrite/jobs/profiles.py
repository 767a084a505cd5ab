"""Versioned reference profiles: what a model version saw in training, and how well it did there.

A save writes the profile's rows (one per feature, each with the metrics of the training report) and the value counts
of all training rows in one committed run. The newest profile of a version is found by one aggregate over the
creation time; drift reads bins from the profile and two-sample distances from the counts beside it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwrite.operators.drift import profile_counts, reference_profile
from underwrite.sources.store import OperationalStore

#: Metrics a concept report compares with.
REFERENCE_METRICS = ("roc_auc", "ks", "brier", "default_rate_observed")


@dataclass(frozen=True)
class StoredProfile:
    """Newest profile of a model version: bins, value counts and training metrics."""

    profile: DataFrame
    counts: DataFrame
    metrics: dict[str, float]


def save_profile(
    store: OperationalStore,
    run: str,
    version: str,
    created_ts: str,
    rows: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    score: str,
    metrics: Mapping[str, float],
) -> bool:
    """Profile the training rows of a version; False if this run was committed before."""
    missing = set(REFERENCE_METRICS) - set(metrics)
    if missing:
        raise ValueError(f"the profile lacks the metrics {sorted(missing)}")
    if store.committed(run):
        return False
    counts = profile_counts(rows, numeric, score)
    profile = reference_profile(rows, numeric, categorical, score, counts=counts)
    stamped = [F.lit(version).alias("model_version"), F.lit(created_ts).cast("timestamp").alias("created_ts")]
    facts = F.create_map(*[x for name, value in sorted(metrics.items()) for x in (F.lit(name), F.lit(float(value)))])
    return store.append(
        run,
        {
            "reference_profile": profile.select(*stamped, "*", facts.alias("reference_metrics")),
            "reference_counts": counts.select(*stamped, "*"),
        },
    )


def newest_profile(store: OperationalStore, version: str) -> StoredProfile | None:
    """The profile of ``version`` created last, None without one."""
    held = store.read("reference_profile").where(F.col("model_version") == version)
    last = held.agg(F.max("created_ts").alias("at")).first()["at"]
    if last is None:
        return None
    newest = held.where(F.col("created_ts") == F.lit(last))
    metrics = newest.agg(F.any_value("reference_metrics").alias("m")).first()["m"]
    counts = store.read("reference_counts").where((F.col("model_version") == version) & (F.col("created_ts") == F.lit(last)))
    return StoredProfile(newest.drop("model_version", "created_ts", "reference_metrics"), counts.select("feature", "value", "n"), dict(metrics))

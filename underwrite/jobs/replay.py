"""Replay job: score the months after those in the log, and append log and delayed outcomes as one run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from underwrite.config import CreditPolicy, ExperimentRules, LoanSpec, ReplayRules
from underwrite.operators.replay import delayed_outcomes, pending_rows, score_months
from underwrite.session import materialize
from underwrite.sources.store import OperationalStore


@dataclass(frozen=True)
class Arms:
    """Scores, versions and threshold of the served models; without a challenger all requests go to the champion."""

    champion: Column
    challenger: Column | None = None
    versions: tuple[str, str] = ("1", "2")
    threshold: float = 0.5


def run_replay(
    store: OperationalStore,
    run: str,
    features: DataFrame,
    arms: Arms,
    spec: LoanSpec | None = None,
    rules: ReplayRules | None = None,
    experiment: ExperimentRules | None = None,
    policy: CreditPolicy | None = None,
) -> bool:
    """Append the next months; False if this run was committed before. The committed log itself is the mark to go on from.

    At the end of the period a run is committed with no rows.
    """
    spec, rules = spec or LoanSpec(), rules or ReplayRules()
    if store.committed(run):
        return False
    pending = pending_rows(features, store.read("inference_log"), spec, rules)
    scored = score_months(pending, arms.champion, arms.challenger, arms.threshold, spec, rules, experiment, policy, arms.versions)
    rows = materialize(scored, "replay-rows")  # log and outcomes from one pass over the features
    outcomes = delayed_outcomes(rows, spec.target, spec.id_column, rules.label_delay_months)
    return store.append(run, {"inference_log": rows.drop(spec.target), "outcomes": outcomes})

"""All registered queries."""

from underwrite.plans import q_jobs, q_loans, q_metrics, q_models, q_risk, q_streaming  # noqa: F401
from underwrite.plans.registry import QUERIES  # noqa: F401

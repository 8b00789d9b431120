"""All registered queries: importing the modules fills the registry."""

from spanloom.plans import q_ci, q_export, q_landed, q_logs, q_sources, q_spans, q_trends  # noqa: F401
from spanloom.plans.registry import ORACLES, QUERIES  # noqa: F401

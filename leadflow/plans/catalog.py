"""Imports every query module so the registry is complete."""

from leadflow.plans import q_kpi, q_enrich, q_events, q_keys, q_functions, q_sources  # noqa: F401
from leadflow.plans.registry import ORACLE, QUERIES  # noqa: F401

"""Derived KPI ratios.

A ratio is a row (name, numerator, denominator, kind): ``percent`` gives
``rate(numerator, denominator)``, ``per`` gives ``revenue_per``. A set of ratios is a plain
mapping by name; :func:`ratio_columns` turns it into one projection over the KPI table, so
everything stays inside Catalyst. Users extend the mapping with :func:`with_ratio`.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadflow.functions.columns import rate, revenue_per


class Ratio(NamedTuple):
    numerator: str
    denominator: str
    kind: str = "percent"


_KINDS = {"percent": rate, "per": revenue_per}

# Which ratios a report has, and of which columns.
RATIOS: Mapping[str, Ratio] = {
    "show_rate": Ratio("sales_call_taken", "new_calls_booked"),
    "unqualified_rate": Ratio("unqualified", "new_calls_booked"),
    "cancellation_rate": Ratio("cancelled_calls", "new_calls_booked"),
    "proposal_rate": Ratio("proposals", "new_calls_booked"),
    "close_rate": Ratio("close", "new_calls_booked"),
    "close_rate_show": Ratio("close", "sales_call_taken"),
    "close_rate_mql": Ratio("close", "proposals"),
    "revenue_per_call": Ratio("closed_revenue", "new_calls_booked", "per"),
    "revenue_per_showed_up": Ratio("closed_revenue", "sales_call_taken", "per"),
    "revenue_per_proposal": Ratio("closed_revenue", "proposals", "per"),
}

# Columns summed in the total row; every other numeric one is averaged.
RAW_METRICS = (
    "new_calls_booked", "sales_call_taken", "unqualified", "cancelled_calls",
    "proposals", "won", "cold_emails", "linkedin", "closed_revenue",
    "pipeline_revenue",
)


def with_ratio(ratios: Mapping[str, Ratio], name: str, ratio: Ratio) -> dict[str, Ratio]:
    """A copy of ``ratios`` with ``name`` added, or replaced where it stands."""
    if ratio.kind not in _KINDS:
        raise ValueError(f"{name}: kind {ratio.kind!r} is none of {sorted(_KINDS)}")
    return {**ratios, name: ratio}


def ratio_columns(ratios: Mapping[str, Ratio] = RATIOS) -> list[Column]:
    return [_KINDS[r.kind](F.col(r.numerator), F.col(r.denominator)).alias(name) for name, r in ratios.items()]

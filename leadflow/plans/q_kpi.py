"""Registered KPI report queries (A1-A10, U1)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from leadflow.functions.metrics import RATIOS, RAW_METRICS, Ratio, with_ratio
from leadflow.operators import cube as C
from leadflow.operators import dashboard as D
from leadflow.operators import kpi as K
from leadflow.plans import duck
from leadflow.plans.fixtures import fixture
from leadflow.plans.common import DATE_COL, END, START, leads_with_origin, sql_leads_origin_with
from leadflow.plans.registry import register
from leadflow.schemas import BOOKED_STAGES, PROPOSAL_STAGES, TAKEN_STAGES
from leadflow.session import scratch_path

# Fixed values, in SQL form: the ratios of a report (name, numerator, denominator, kind).
_DERIVED_SQL = [
    ("show_rate", "sales_call_taken", "new_calls_booked", "rate"),
    ("unqualified_rate", "unqualified", "new_calls_booked", "rate"),
    ("cancellation_rate", "cancelled_calls", "new_calls_booked", "rate"),
    ("proposal_rate", "proposals", "new_calls_booked", "rate"),
    ("close_rate", "close", "new_calls_booked", "rate"),
    ("close_rate_show", "close", "sales_call_taken", "rate"),
    ("close_rate_mql", "close", "proposals", "rate"),
    ("revenue_per_call", "closed_revenue", "new_calls_booked", "div"),
    ("revenue_per_showed_up", "closed_revenue", "sales_call_taken", "div"),
    ("revenue_per_proposal", "closed_revenue", "proposals", "div"),
]

_SPECS = {
    # report: (key, taken uses S, unqualified uses S, channels, channel filtered)
    "overview": ("owner", False, False, [("cold_emails", "origin = 'cold-email'")], False),
    "cold_email": ("owner", True, True, [("cold_emails", "origin = 'cold-email'")], False),
    "linkedin": ("owner", True, False, [("linkedin_leads", "origin = 'LinkedIn'")], False),
    "google_ads": ("owner", True, True, [("google_ads", "utm_source = 'google-ads'")], False),
    "by_campaign": ("utm_campaign", True, True, [("google_ads", None)], True),
    "by_content": ("utm_content", True, True, [("google_ads", None)], True),
}


def _lst(vals):
    return ", ".join(duck.q(v) for v in vals)


def sql_raw_kpis(report: str, src: str = "leads_origin") -> tuple[str, list[str]]:
    key, taken_s, unq_s, channels, filtered = _SPECS[report]
    in_f = duck.in_range(DATE_COL, START, END)
    in_s = duck.in_range("sales_call_date", START, END)
    gflt = "coalesce(utm_source = 'google-ads', false)"
    booked = f"(in_f AND {gflt})" if filtered else "in_f"
    taken = "in_s" if taken_s else "in_f"
    unq = "in_s" if unq_s else "in_f"
    cols = [
        (duck.count_if(booked), "new_calls_booked"),
        (duck.count_if(f"stage IN ({_lst(TAKEN_STAGES)}) AND {taken}"), "sales_call_taken"),
        (duck.count_if(f"stage = 'unqualified' AND {unq}"), "unqualified"),
        (duck.count_if("stage = 'cancelled' AND in_f"), "cancelled_calls"),
        (duck.count_if(f"stage IN ({_lst(PROPOSAL_STAGES)}) AND in_s"), "proposals"),
        (duck.count_if("stage = 'won' AND in_s"), "won"),
    ]
    for name, cond in channels:
        c = booked if cond is None else f"in_f AND coalesce({cond}, false)"
        cols.append((duck.count_if(c), name))
    cols += [
        (duck.count_if("stage = 'won' AND in_s"), "close"),
        (duck.nearest_double("sum(CASE WHEN stage = 'won' AND in_f THEN CAST(amt AS DECIMAL(28, 9)) ELSE 0 END)"), "closed_revenue"),
        (duck.nearest_double("sum(CASE WHEN stage = 'proposal' AND in_f THEN CAST(amt AS DECIMAL(28, 9)) ELSE 0 END)"), "pipeline_revenue"),
    ]
    having = f" HAVING count_if({gflt}) > 0" if filtered else ""
    body = (f"SELECT {key}, " + ", ".join(f"{e} AS {n}" for e, n in cols) +
            f" FROM (SELECT *, {in_f} AS in_f, {in_s} AS in_s, {duck.to_number('deal_value')} AS amt FROM {src}) r"
            f" WHERE {key} IS NOT NULL AND stage IN ({_lst(BOOKED_STAGES)}) GROUP BY {key}{having}")
    names = [key] + [n for _, n in cols]
    if report == "overview":
        i = names.index("cold_emails") + 1
        names.insert(i, "linkedin")
        body = (f"SELECT *, CAST(CASE WHEN new_calls_booked > 0 THEN new_calls_booked - cold_emails ELSE 0 END AS BIGINT) AS linkedin FROM ({body}) x")
    return body, names


def sql_derived(src: str) -> str:
    parts = []
    for name, n, d, kind in _DERIVED_SQL:
        e = duck.rate(n, d) if kind == "rate" else duck.safe_divide(n, d)
        parts.append(f"{e} AS {name}")
    return f"SELECT *, {', '.join(parts)} FROM {src}"


def sql_report(report: str, total: bool = True, extra_metrics=()) -> str:
    key = _SPECS[report][0]
    raw, names = sql_raw_kpis(report)
    derived = [n for n, *_ in _DERIVED_SQL] + [n for n, _ in extra_metrics]
    extra = "".join(f", {e} AS {n}" for n, e in extra_metrics)
    cte = sql_leads_origin_with(f"k AS ({raw})", f"d AS ({sql_derived('k')}{extra and ''})")
    if extra_metrics:
        cte = sql_leads_origin_with(f"k AS ({raw})", f"d0 AS ({sql_derived('k')})",
                                    f"d AS (SELECT *{extra} FROM d0)")
    out_cols = [c for c in names if c != "close"] + derived
    select_groups = f"SELECT {', '.join(out_cols)} FROM d"
    if not total:
        return cte + select_groups
    tcols = []
    for c in out_cols[1:]:
        if c in RAW_METRICS:
            tcols.append(f"{duck.nearest_double(f'coalesce(sum(CAST(CAST({c} AS VARCHAR) AS DECIMAL(28, 9))), 0)')} AS {c}" if "revenue" in c
                         else f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}")
        else:
            tcols.append(f"round(avg({c}), 9) AS {c}")
    having = " HAVING count(*) > 0" if _SPECS[report][4] else ""
    return (cte + select_groups + " UNION ALL SELECT 'Total' AS " + key + ", " +
            ", ".join(tcols) + f" FROM d{having}")


def _report(report: str):
    def q(spark, sf_dir):
        return K.kpi_report(leads_with_origin(spark, sf_dir), report, START, END, DATE_COL)
    return q


for _r in _SPECS:
    register(f"kpi_{_r}", sql_report(_r))(_report(_r))


@register("kpi_total_only", f"SELECT * FROM ({sql_report('overview')}) t WHERE owner = 'Total'")
def kpi_total_only(spark, sf_dir):
    return K.kpi_overview(leads_with_origin(spark, sf_dir), START, END).filter(F.col("owner") == "Total")


@register("kpi_derived", sql_report("overview", total=False))
def kpi_derived(spark, sf_dir):
    leads = leads_with_origin(spark, sf_dir)
    raw = K.raw_kpis(leads, K.spec("overview"), START, END, DATE_COL)
    return K.with_derived_metrics(raw).drop("close")


@register("kpi_custom_metric", sql_report("overview", extra_metrics=[("won_per_proposal_rate", duck.rate("won", "proposals"))]))
def kpi_custom_metric(spark, sf_dir):
    metrics = with_ratio(RATIOS, "won_per_proposal_rate", Ratio("won", "proposals"))
    return K.kpi_overview(leads_with_origin(spark, sf_dir), START, END, metrics=metrics)


def _sql_utm(key: str) -> str:
    in_f = duck.in_range(DATE_COL, START, END)
    return (sql_leads_origin_with() +
            f"SELECT {key}, CAST(count(*) AS BIGINT) AS count, CAST(sum(CAST({duck.to_number('deal_value')} AS DECIMAL(28, 9))) AS DOUBLE) AS total_deal_value "
            f"FROM leads WHERE stage IN ({_lst(BOOKED_STAGES)}) AND {in_f} AND {key} IS NOT NULL GROUP BY {key}")


@register("utm_campaigns", _sql_utm("utm_campaign"))
def utm_campaigns(spark, sf_dir):
    return K.utm_rollup(fixture(spark, sf_dir, "leads"), "utm_campaign", START, END)


@register("utm_contents", _sql_utm("utm_content"))
def utm_contents(spark, sf_dir):
    return K.utm_rollup(fixture(spark, sf_dir, "leads"), "utm_content", START, END)


@register("agg_distinct_keys", sql_leads_origin_with() +
          "SELECT owner, min(seq) AS first_seen FROM leads WHERE owner IS NOT NULL GROUP BY owner")
def agg_distinct_keys(spark, sf_dir):
    from leadflow.plans.fixtures import fixture
    return K.distinct_keys(fixture(spark, sf_dir, "leads"), "owner")


# --- all reports at once ---------------------------------------------------------

def sql_dashboard() -> str:
    """The six report texts side by side, with null for the metrics a report lacks."""
    columns, parts = [], []
    for report in _SPECS:
        columns += [c for c in sql_raw_kpis(report)[1][1:] if c not in columns and c != "close"]
    columns += [n for n, *_ in _DERIVED_SQL]
    for report, (key, *_) in _SPECS.items():
        own = sql_raw_kpis(report)[1] + [n for n, *_ in _DERIVED_SQL]
        shown = ", ".join(c if c in own else f"NULL AS {c}" for c in columns)
        parts.append(f"SELECT '{report}' AS report, {key} AS key, {shown} FROM ({sql_report(report)}) {report}")
    return "\nUNION ALL\n".join(parts)


@register("kpi_dashboard", sql_dashboard())
def kpi_dashboard(spark, sf_dir):
    return D.dashboard(leads_with_origin(spark, sf_dir), START, END, DATE_COL)


# A later report window than the one above, half a month off its edges.
LATER_START, LATER_END = "1996-02-14", "2000-11-15"


def sql_later() -> str:
    return sql_dashboard().replace(START, LATER_START).replace(END, LATER_END)


@register("kpi_dashboard_range", sql_later())
def kpi_dashboard_range(spark, sf_dir):
    """All reports from a cube stored in two refreshes, of the leads with odd and even numbers."""
    root, leads = scratch_path(spark, "lead-cube"), leads_with_origin(spark, sf_dir)
    for n in (0, 1):
        C.add_run(leads.filter(F.col("seq") % 2 == n), root, f"refresh-{n}", dt.datetime(2024, 1, 1 + n), DATE_COL)
    return C.cube_dashboard(spark, root, LATER_START, LATER_END)

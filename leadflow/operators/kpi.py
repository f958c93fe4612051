"""Funnel KPI reports.

The source system builds each report from nine or more separate
filter + group-by + re-index passes over per-stage tables. Here a report is
one conditional aggregation over the single ``leads`` table (``stage`` is a
column): every metric is a ``count_if``/``sum(when)`` over the same
``groupBy(key)``, so a report is one scan and one shuffle of partial
aggregates (map-side combine keeps the shuffle at one row per key and task,
however skewed the keys are). Derived metrics are a projection; the total
row is a global aggregate of that small result.

Report specs
------------
``F`` = the user's date column, ``S``/``P`` = the sales-call date column
(falls back to ``F`` when ``sales_date_col`` is None).

=============  ========  =====  ===========  ===============================
report         key       taken  unqualified  channel column
=============  ========  =====  ===========  ===============================
overview       owner     F      F            cold_emails, linkedin (derived)
cold_email     owner     S      S            cold_emails
linkedin       owner     S      F            linkedin_leads
google_ads     owner     S      S            google_ads
by_campaign    campaign  S      S            google_ads (= booked)
by_content     content   S      S            google_ads (= booked)
=============  ========  =====  ===========  ===============================
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.columns import in_date_range, to_number
from leadflow.functions.metrics import RATIOS, RAW_METRICS, Ratio, ratio_columns
from leadflow.schemas import (BOOKED_STAGES, ORIGIN_COLD_EMAIL, ORIGIN_LINKEDIN,
                              PROPOSAL_STAGES, TAKEN_STAGES)

TOTAL_LABEL = "Total"
GOOGLE_ADS = "google-ads"


@dataclass(frozen=True)
class Channel:
    """A channel metric: ``count_if(F-range & cond)`` named ``name``."""
    name: str
    cond: Column | None          # None -> same as booked (channel-filtered reports)


@dataclass(frozen=True)
class ReportSpec:
    key: str
    taken_uses_sales_date: bool
    unqualified_uses_sales_date: bool
    channels: tuple = field(default_factory=tuple)
    # Booked count and key set restricted to rows matching this filter.
    channel_filter: Column | None = None
    # Overview: LinkedIn = booked - cold e-mails when booked > 0.
    derived_linkedin: bool = False


def _origin_is(v: str) -> Column:
    return F.col("origin") == F.lit(v)


def _utm_is_google() -> Column:
    return F.col("utm_source") == F.lit(GOOGLE_ADS)


def spec(name: str, utm_source_present: bool = True) -> ReportSpec:
    """The six report specs of the funnel dashboard."""
    if name == "overview":
        return ReportSpec("owner", False, False,
                          (Channel("cold_emails", _origin_is(ORIGIN_COLD_EMAIL)),),
                          derived_linkedin=True)
    if name == "cold_email":
        return ReportSpec("owner", True, True,
                          (Channel("cold_emails", _origin_is(ORIGIN_COLD_EMAIL)),))
    if name == "linkedin":
        return ReportSpec("owner", True, False,
                          (Channel("linkedin_leads", _origin_is(ORIGIN_LINKEDIN)),))
    if name == "google_ads":
        return ReportSpec("owner", True, True,
                          (Channel("google_ads", _utm_is_google()),))
    if name in ("by_campaign", "by_content"):
        key = "utm_campaign" if name == "by_campaign" else "utm_content"
        # Without a utm_source column the source skips the channel filter.
        flt = _utm_is_google() if utm_source_present else None
        return ReportSpec(key, True, True, (Channel("google_ads", None),),
                          channel_filter=flt if flt is not None else F.lit(True))
    raise ValueError(f"unknown report {name!r}")


def exact_sum(c: Column) -> Column:
    """Sum of doubles that does not depend on their order: as decimals of nine
    places; what no such decimal holds (infinities, 1e19 and over) as doubles."""
    d = c.try_cast("decimal(28,9)")
    return (F.coalesce(F.sum(d).cast("double"), F.lit(0.0))
            + F.coalesce(F.sum(F.when(d.isNull(), c)), F.lit(0.0)))


def raw_kpis(leads: DataFrame, rspec: ReportSpec, start, end,
             date_col: str = "date_created",
             sales_date_col: str | None = "sales_call_date") -> DataFrame:
    """Raw metric table (one row per key, plus the hidden ``close``)."""
    key = rspec.key
    if key not in leads.columns:
        raise ValueError(f"leads has no {key!r} column")
    sd = sales_date_col if sales_date_col in leads.columns else date_col
    in_f = in_date_range(date_col, start, end)
    in_s = in_date_range(sd, start, end)
    stage = F.col("stage")
    chan = rspec.channel_filter

    amount = to_number(F.col("deal_value")) if "deal_value" in leads.columns else F.lit(0.0)
    # Narrow projection first: each coerced date and the amount are computed
    # once per row, and the aggregate works on plain boolean/double columns.
    chan_conds = [F.coalesce(ch.cond, F.lit(False)) for ch in rspec.channels if ch.cond is not None]
    rows = (leads.filter(F.col(key).isNotNull() & stage.isin(*BOOKED_STAGES))
                 .select(key, "stage", in_f.alias("_f"), in_s.alias("_s"), amount.alias("_amt"),
                         F.coalesce(chan, F.lit(False)).alias("_chan") if chan is not None else F.lit(True).alias("_chan"),
                         *[c.alias(f"_ch{i}") for i, c in enumerate(chan_conds)]))
    in_f, in_s = F.col("_f"), F.col("_s")
    in_taken = in_s if rspec.taken_uses_sales_date else in_f
    in_unq = in_s if rspec.unqualified_uses_sales_date else in_f
    in_p = in_s
    booked = in_f & F.col("_chan")
    amount = F.col("_amt")
    aggs = [
        F.count_if(booked).alias("new_calls_booked"),
        F.count_if(stage.isin(*TAKEN_STAGES) & in_taken).alias("sales_call_taken"),
        F.count_if((stage == "unqualified") & in_unq).alias("unqualified"),
        F.count_if((stage == "cancelled") & in_f).alias("cancelled_calls"),
        F.count_if(stage.isin(*PROPOSAL_STAGES) & in_p).alias("proposals"),
        F.count_if((stage == "won") & in_p).alias("won"),
    ]
    n_cond = 0
    for ch in rspec.channels:
        if ch.cond is None:
            cond = booked
        else:
            cond = in_f & F.col(f"_ch{n_cond}")
            n_cond += 1
        aggs.append(F.count_if(cond).alias(ch.name))
    aggs += [
        F.count_if((stage == "won") & in_p).alias("close"),
        exact_sum(F.when((stage == "won") & in_f, amount)).alias("closed_revenue"),
        exact_sum(F.when((stage == "proposal") & in_f, amount)).alias("pipeline_revenue"),
    ]
    if chan is not None:
        aggs.append(F.count_if(F.col("_chan")).alias("_in_channel"))

    kpi = rows.groupBy(key).agg(*aggs)
    if chan is not None:
        kpi = kpi.filter(F.col("_in_channel") > 0).drop("_in_channel")
    if rspec.derived_linkedin:
        li = (F.when(F.col("new_calls_booked") > 0,
                     F.col("new_calls_booked") - F.col("cold_emails"))
               .otherwise(F.lit(0)).cast("long").alias("linkedin"))
        cols = kpi.columns
        pos = cols.index("cold_emails") + 1
        kpi = kpi.select(*cols[:pos], li, *cols[pos:])
    return kpi


def with_derived_metrics(kpi: DataFrame, metrics: Mapping[str, Ratio] = RATIOS) -> DataFrame:
    """Append the derived ratios as a projection."""
    return kpi.select("*", *ratio_columns(metrics))


def with_total_row(kpi: DataFrame, key: str, raw_metrics=RAW_METRICS,
                   label: str = TOTAL_LABEL, drop=("close",),
                   mean_scale: int | None = 9,
                   only_if_rows: bool = False) -> DataFrame:
    """Append a ``Total`` row: sum of raw metrics, unweighted mean of every
    other numeric column (so rates are averaged over groups).

    Means are rounded to ``mean_scale`` decimals, and money is summed exactly, so
    the row does not depend on the summation order across partitions.
    ``only_if_rows`` skips the row
    for an empty table (campaign/content reports).
    """
    types = {f.name: f.dataType.typeName() for f in kpi.schema.fields}
    numeric = [f.name for f in kpi.schema.fields
               if f.name != key and f.dataType.typeName() in
               ("long", "integer", "double", "float", "short", "decimal")]
    exprs = []
    for c in numeric:
        if c in raw_metrics:
            s = exact_sum(F.col(c)) if types[c] in ("double", "float") else F.coalesce(F.sum(c), F.lit(0))
            exprs.append(s.alias(c))
        else:
            m = F.avg(c)
            exprs.append((F.round(m, mean_scale) if mean_scale is not None else m).alias(c))
    total = kpi.agg(*exprs, F.count(F.lit(1)).alias("_n"))
    if only_if_rows:
        total = total.filter(F.col("_n") > 0)
    total = total.drop("_n").withColumn(key, F.lit(label))
    out = kpi.unionByName(total.select(*kpi.columns))
    return out.drop(*[d for d in drop if d in out.columns])


def kpi_report(leads: DataFrame, report: str, start, end,
               date_col: str = "date_created",
               sales_date_col: str | None = "sales_call_date",
               metrics: Mapping[str, Ratio] = RATIOS,
               total: bool = True) -> DataFrame:
    """One of the six dashboard reports (see module doc)."""
    rspec = spec(report, "utm_source" in leads.columns)
    kpi = raw_kpis(leads, rspec, start, end, date_col, sales_date_col)
    kpi = with_derived_metrics(kpi, metrics)
    if not total:
        return kpi.drop("close")
    return with_total_row(kpi, rspec.key,
                          only_if_rows=rspec.channel_filter is not None)


def kpi_overview(leads, start, end, date_col="date_created", **kw):
    return kpi_report(leads, "overview", start, end, date_col, **kw)


def kpi_cold_email(leads, start, end, date_col="date_created", **kw):
    return kpi_report(leads, "cold_email", start, end, date_col, **kw)


def kpi_linkedin(leads, start, end, date_col="date_created", **kw):
    return kpi_report(leads, "linkedin", start, end, date_col, **kw)


def kpi_google_ads(leads, start, end, date_col="date_created", **kw):
    return kpi_report(leads, "google_ads", start, end, date_col, **kw)


def kpi_by_campaign(leads, start, end, date_col="date_created", **kw):
    return kpi_report(leads, "by_campaign", start, end, date_col, **kw)


def kpi_by_content(leads, start, end, date_col="date_created", **kw):
    return kpi_report(leads, "by_content", start, end, date_col, **kw)


def utm_rollup(leads: DataFrame, key: str, start, end,
               date_col: str = "date_created") -> DataFrame:
    """``(key, count, total_deal_value)`` over all leads (no channel filter).

    A missing date column means no date filter; a missing deal column sums 0.
    Null keys are dropped; ``''`` is a key.
    """
    rows = leads.filter(F.col("stage").isin(*BOOKED_STAGES)) if "stage" in leads.columns else leads
    if date_col in rows.columns:
        rows = rows.filter(in_date_range(date_col, start, end))
    amount = to_number("deal_value") if "deal_value" in rows.columns else F.lit(0.0)
    return (rows.filter(F.col(key).isNotNull())
                .groupBy(key)
                .agg(F.count(F.lit(1)).alias("count"),
                     exact_sum(amount).alias("total_deal_value")))


def distinct_keys(df: DataFrame, col: str, order_col: str = "seq") -> DataFrame:
    """Non-null distinct keys with their first-seen position ``first_seen``
    (order by it for display)."""
    return (df.filter(F.col(col).isNotNull())
              .groupBy(col).agg(F.min(order_col).alias("first_seen")))


def key_order(leads: DataFrame, key: str, order_col: str = "seq") -> DataFrame:
    """First-seen position of each key: stages in report order
    (cancelled, lost, noshow, proposal, scheduled, unqualified, won), then
    rows by ``order_col``; one partial aggregate."""
    from leadflow.schemas import STAGE_ORDER
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), F.col("stage"))
    return (leads.filter(F.col(key).isNotNull() & (rank > 0))
                 .groupBy(key)
                 .agg(F.min(F.struct(rank.alias("r"), F.col(order_col).alias("o"))).alias("_ord")))


def display_order(report: DataFrame, leads: DataFrame, key: str, order_col: str = "seq") -> DataFrame:
    """The report sorted for display: keys in first-seen order, ``Total``
    last (reports are bags; use this only to present them)."""
    ordered = report.join(key_order(leads, key, order_col), key, "left")
    return (ordered.orderBy(F.col(key) == F.lit(TOTAL_LABEL), F.col("_ord").asc_nulls_last())
                   .drop("_ord"))

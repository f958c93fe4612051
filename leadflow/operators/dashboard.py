"""All six funnel reports from one pass over the leads.

The reports share their rows and most of their counts and differ in the key (owner,
campaign, content) and in which date a count follows. :func:`shared_metrics` computes the union of
all their counts over grouping sets of the three keys: one scan, one shuffle of partial
aggregates. :func:`assemble` makes the rows of every report out of that small table, with ratios and
total rows, in one more aggregate of a row per report and key.

The result is long: ``(report, key, <metric columns of any report>)``, a metric being
null in the reports that lack it. :func:`report_of` gives one report the columns that
:func:`leadflow.operators.kpi.kpi_report` gives it.

Shared metrics, ``c`` following the created date and ``s`` the sales-call date:

=======================  ====================================================
booked, booked_channel   leads booked in range; those of the ad channel
taken_c, taken_s         calls taken
unqualified_c, _s        unqualified calls
cancelled                cancelled calls (created date)
proposals, won           sales-call date
cold, linkedin, google   booked leads by origin and by ad channel
won_amount,              money of won and of proposed leads (created date)
proposal_amount
rows, channel_rows       leads of the key in all, whatever their dates; those of the ad channel
=======================  ====================================================
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.columns import in_date_range, to_number
from leadflow.functions.metrics import RATIOS, RAW_METRICS, Ratio, ratio_columns
from leadflow.operators import kpi as K
from leadflow.schemas import BOOKED_STAGES, ORIGIN_COLD_EMAIL, ORIGIN_LINKEDIN, PROPOSAL_STAGES, TAKEN_STAGES

REPORTS = ("overview", "cold_email", "linkedin", "google_ads", "by_campaign", "by_content")
KEYS = ("owner", "utm_campaign", "utm_content")
#: Counts, then money, of the shared table.
COUNTS = ("booked", "booked_channel", "taken_c", "taken_s", "unqualified_c", "unqualified_s", "cancelled",
          "proposals", "won", "cold", "linkedin", "google", "rows", "channel_rows")
AMOUNTS = ("won_amount", "proposal_amount")
#: Which shared metric a report's channel column shows.
CHANNELS = {"cold_emails": "cold", "linkedin_leads": "linkedin", "google_ads": "google"}


def lead_flags(leads: DataFrame) -> dict[str, Column]:
    """Origin and channel of a lead as plain booleans; ``channel``: whether campaign and content reports
    count it (all leads, where there is no channel column)."""
    origin = (lambda v: F.coalesce(F.col("origin") == v, F.lit(False))) if "origin" in leads.columns else (lambda v: F.lit(False))
    google = F.coalesce(F.col("utm_source") == K.GOOGLE_ADS, F.lit(False)) if "utm_source" in leads.columns else F.lit(False)
    return {"cold": origin(ORIGIN_COLD_EMAIL), "linkedin": origin(ORIGIN_LINKEDIN), "google": google,
            "channel": google if "utm_source" in leads.columns else F.lit(True)}


def lead_amount(leads: DataFrame) -> Column:
    return to_number("deal_value") if "deal_value" in leads.columns else F.lit(0.0)


def present_keys(leads: DataFrame) -> list[str]:
    keys = [k for k in KEYS if k in leads.columns]
    if not keys:
        raise ValueError(f"leads has none of the key columns {KEYS}")
    return keys


def shared_metrics(leads: DataFrame, start, end, date_col: str = "date_created",
                   sales_date_col: str | None = "sales_call_date") -> DataFrame:
    """``(dim, key, *COUNTS, *AMOUNTS)``: one row per key of each key column (null keys: none)."""
    keys, flags = present_keys(leads), lead_flags(leads)
    sales = sales_date_col if sales_date_col in leads.columns else date_col
    rows = (leads.filter(F.col("stage").isin(*BOOKED_STAGES))
            .select(*keys, "stage", in_date_range(date_col, start, end).alias("_c"), in_date_range(sales, start, end).alias("_s"),
                    lead_amount(leads).alias("_amount"), *[f.alias(f"_{n}") for n, f in flags.items()]))
    stage, c, s, amount = F.col("stage"), F.col("_c"), F.col("_s"), F.col("_amount")
    taken = stage.isin(*TAKEN_STAGES)
    counted = {
        "booked": c, "booked_channel": c & F.col("_channel"), "taken_c": taken & c, "taken_s": taken & s,
        "unqualified_c": (stage == "unqualified") & c, "unqualified_s": (stage == "unqualified") & s,
        "cancelled": (stage == "cancelled") & c, "proposals": stage.isin(*PROPOSAL_STAGES) & s, "won": (stage == "won") & s,
        "cold": c & F.col("_cold"), "linkedin": c & F.col("_linkedin"), "google": c & F.col("_google"),
        "rows": F.lit(True), "channel_rows": F.col("_channel"),
    }
    per_set = (rows.groupingSets([[F.col(k)] for k in keys], *keys)
               .agg(F.grouping_id(*keys).alias("_set"), *[F.count_if(counted[n]).alias(n) for n in COUNTS],
                    K.exact_sum(F.when((stage == "won") & c, amount)).alias("won_amount"),
                    K.exact_sum(F.when((stage == "proposal") & c, amount)).alias("proposal_amount")))
    # The bit of a key that a set groups by is 0, those of the others are 1.
    every = (1 << len(keys)) - 1
    dim, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        here = F.col("_set") == (every ^ (1 << (len(keys) - 1 - i)))
        dim, key = F.when(here, k).otherwise(dim), F.when(here, F.col(k).cast("string")).otherwise(key)
    return per_set.select(dim.alias("dim"), key.alias("key"), *COUNTS, *AMOUNTS).filter(F.col("key").isNotNull())


def _raw_columns(report: str) -> dict[str, Column]:
    """The raw metrics of a report, and the hidden ``close``, out of the shared ones."""
    s = K.spec(report)
    by_channel = s.channel_filter is not None
    booked = F.col("booked_channel" if by_channel else "booked")
    out = {"new_calls_booked": booked, "sales_call_taken": F.col("taken_s" if s.taken_uses_sales_date else "taken_c"),
           "unqualified": F.col("unqualified_s" if s.unqualified_uses_sales_date else "unqualified_c"),
           "cancelled_calls": F.col("cancelled"), "proposals": F.col("proposals"), "won": F.col("won")}
    for ch in s.channels:
        out[ch.name] = booked if by_channel else F.col(CHANNELS[ch.name])
        if s.derived_linkedin:
            out["linkedin"] = F.when(booked > 0, booked - out["cold_emails"]).otherwise(0).cast("long")
    return out | {"close": F.col("won"), "closed_revenue": F.col("won_amount"), "pipeline_revenue": F.col("proposal_amount")}


def _columns(reports: Sequence[str], metrics: Mapping[str, Ratio]) -> list[str]:
    """All raw columns of the reports in their order, then the ratios."""
    return list(dict.fromkeys(c for r in reports for c in _raw_columns(r))) + list(metrics)


def assemble(shared: DataFrame, reports: Sequence[str] = REPORTS, metrics: Mapping[str, Ratio] = RATIOS,
             total: bool = True, mean_scale: int = 9) -> DataFrame:
    """``(report, key, *metrics)`` of all ``reports`` from the shared metrics, each with its total
    row (sum of the raw metrics, mean of the others; campaign and content reports have
    one only if they have rows)."""
    raw = _columns(reports, {})
    money = ("closed_revenue", "pipeline_revenue")
    kind = {c: "double" if c in money else "long" for c in raw}

    def row(report: str) -> Column:
        own = _raw_columns(report)
        s = K.spec(report)
        wanted = (F.col("dim") == s.key) & (F.col("channel_rows") > 0 if s.channel_filter is not None else F.lit(True))
        return F.when(wanted, F.struct(F.lit(report).alias("report"), "key", *[
            (own[c] if c in own else F.lit(None)).cast(kind[c]).alias(c) for c in raw]))

    rows = shared.select(F.inline(F.array_compact(F.array(*[row(r) for r in reports]))))
    rows = rows.select("report", "key", *raw, *ratio_columns(metrics))
    shown = [c for c in rows.columns if c not in ("report", "key", "close")]
    if not total:
        return rows.select("report", "key", *shown)

    # A row per report without a key makes owner reports with no rows have a total.
    spine = [r for r in reports if K.spec(r).channel_filter is None]
    empty = shared.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r) for r in spine]).cast("array<string>")).alias("report"))
    per = rows.unionByName(empty, allowMissingColumns=True)
    is_total = F.grouping_id("report", "key") > 0

    def total_of(c: str) -> Column:
        if c not in RAW_METRICS:
            return F.round(F.avg(c), mean_scale)
        return K.exact_sum(F.col(c)) if kind.get(c) == "double" else F.coalesce(F.sum(c), F.lit(0))

    out = (per.groupingSets([[F.col("report"), F.col("key")], [F.col("report")]], "report", "key")
           .agg(is_total.alias("_total"), *[F.when(is_total, total_of(c)).otherwise(F.any_value(c)).alias(c) for c in shown])
           .filter(F.col("_total") | F.col("key").isNotNull()))
    has = {c: [r for r in reports if c in _raw_columns(r)] for c in raw}
    return out.select("report", F.when(F.col("_total"), K.TOTAL_LABEL).otherwise(F.col("key")).alias("key"), *[
        F.when(F.col("report").isin(*has[c]), F.col(c)).alias(c) if c in has else F.col(c) for c in shown])


def dashboard(leads: DataFrame, start, end, date_col: str = "date_created", sales_date_col: str | None = "sales_call_date",
              reports: Sequence[str] = REPORTS, metrics: Mapping[str, Ratio] = RATIOS, total: bool = True) -> DataFrame:
    """All reports over leads dated ``start`` to ``end``, in one scan and one shuffle of ``leads``."""
    have = present_keys(leads)
    reports = [r for r in reports if K.spec(r).key in have]
    return assemble(shared_metrics(leads, start, end, date_col, sales_date_col), reports, metrics, total)


def report_of(board: DataFrame, report: str, metrics: Mapping[str, Ratio] = RATIOS) -> DataFrame:
    """One report out of a (stored) dashboard, with its own key and metric columns."""
    cols = [c for c in _columns([report], metrics) if c != "close"]
    return board.filter(F.col("report") == report).select(F.col("key").alias(K.spec(report).key), *cols)

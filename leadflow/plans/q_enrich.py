"""Registered enrichment, filter, set and ordering queries over bookings and leads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from leadflow.functions.columns import to_number
from leadflow.operators import analytics as A
from leadflow.operators import bounded as B
from leadflow.operators import joins as J
from leadflow.operators import transform as T
from leadflow.plans import duck
from leadflow.plans.common import (SQL_ENRICHED, SQL_FIRST_INVITEE, SQL_ORIGIN_CASE,
                                   SQL_TYPED_BOOKINGS, TARGET_TYPES, enriched_bookings,
                                   leads_with_origin, sql_leads_origin_with, sql_with, typed_bookings)
from leadflow.plans.fixtures import FIXTURE_TYPE_ORIGINS, fixture
from leadflow.plans.registry import register
from leadflow.session import literal_table

LEAD_COLS = ["item_id", "stage", "owner", "email", "origin"]

_ENRICH_WITH = sql_with(("bookings", "invitees"), SQL_TYPED_BOOKINGS, SQL_FIRST_INVITEE, SQL_ENRICHED)


@register("join_origin", sql_leads_origin_with() + f"SELECT {', '.join(LEAD_COLS)} FROM leads_origin")
def join_origin(spark, sf_dir):
    return leads_with_origin(spark, sf_dir).select(*LEAD_COLS)


@register("join_origin_binary", sql_with(("leads", "bookings", "invitees"), SQL_TYPED_BOOKINGS,
                                         SQL_FIRST_INVITEE, SQL_ENRICHED) +
          "SELECT l.item_id, l.email, CASE WHEN l.email IN (SELECT invitee_email FROM enriched_bookings "
          "WHERE invitee_email IS NOT NULL) THEN 'cold-email' ELSE 'LinkedIn' END AS origin FROM leads l")
def join_origin_binary(spark, sf_dir):
    out = J.annotate_origins_binary(fixture(spark, sf_dir, "leads"), enriched_bookings(spark, sf_dir))
    return out.select("item_id", "email", "origin")


@register("join_first_invitee", _ENRICH_WITH +
          "SELECT uri, status, event_type, origin, invitee_name, invitee_email FROM enriched_bookings")
def join_first_invitee(spark, sf_dir):
    return enriched_bookings(spark, sf_dir).select("uri", "status", "event_type", "origin",
                                                   "invitee_name", "invitee_email")


@register("win_first_per_key", sql_with(("invitees",), SQL_FIRST_INVITEE) +
          "SELECT event_uri, invitee_name, invitee_email FROM first_invitee")
def win_first_per_key(spark, sf_dir):
    return J.first_invitee(fixture(spark, sf_dir, "invitees"))


@register("proj_event_origin", sql_with(("bookings",)) +
          f"SELECT uri, event_type, {SQL_ORIGIN_CASE} AS origin FROM bookings")
def proj_event_origin(spark, sf_dir):
    b = fixture(spark, sf_dir, "bookings")
    return T.tag_event_origin(b, FIXTURE_TYPE_ORIGINS).select("uri", "event_type", "origin")


@register("agg_origin_breakdown", sql_leads_origin_with() +
          "SELECT origin, CAST(count(*) AS BIGINT) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS pct "
          "FROM leads_origin GROUP BY origin")
def agg_origin_breakdown(spark, sf_dir):
    return A.origin_breakdown(leads_with_origin(spark, sf_dir))


@register("agg_event_origin_counts", sql_with(("bookings",), SQL_TYPED_BOOKINGS) +
          "SELECT l.origin, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM (VALUES ('cold-email'), ('cold-calling')) l(origin) "
          "LEFT JOIN (SELECT origin, count(*) AS n FROM typed_bookings GROUP BY origin) c ON l.origin = c.origin")
def agg_event_origin_counts(spark, sf_dir):
    return A.event_origin_counts(typed_bookings(spark, sf_dir), list(FIXTURE_TYPE_ORIGINS))


@register("agg_enrichment_coverage", _ENRICH_WITH +
          "SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(invitee_email) AS BIGINT) AS enriched, "
          "coalesce(count(invitee_email) * 100.0 / NULLIF(count(*), 0), 0.0) AS pct FROM enriched_bookings")
def agg_enrichment_coverage(spark, sf_dir):
    return A.enrichment_coverage(enriched_bookings(spark, sf_dir))


@register("agg_origin_emails", _ENRICH_WITH +
          "SELECT origin, CAST(count(DISTINCT invitee_email) AS BIGINT) AS unique_emails FROM enriched_bookings "
          "WHERE origin IS NOT NULL GROUP BY origin")
def agg_origin_emails(spark, sf_dir):
    return A.origin_emails(enriched_bookings(spark, sf_dir))


@register("sort_start_time", sql_with(("bookings",), SQL_TYPED_BOOKINGS) +
          "SELECT uri, start_time, origin FROM typed_bookings ORDER BY start_time DESC, uri")
def sort_start_time(spark, sf_dir):
    return T.sort_desc(typed_bookings(spark, sf_dir), "start_time", tie="uri").select("uri", "start_time", "origin")


# Look-back: 'now' is a parameter; the fixture's bookings span 2024-01-01..30.
NOW = dt.datetime(2024, 1, 31, 12, 0, 0)


@register("filt_lookback", sql_with(("bookings",)) +
          "SELECT uri, start_time FROM bookings WHERE start_time >= TIMESTAMP '2024-01-11 12:00:00'")
def filt_lookback(spark, sf_dir):
    return T.filter_lookback(fixture(spark, sf_dir, "bookings"), "start_time", 20, NOW).select("uri", "start_time")


@register("filt_lookback_upper", sql_with(("invitees",)) +
          "SELECT uri, created_at FROM invitees WHERE created_at >= TIMESTAMP '2024-01-06 00:00:00' "
          "AND created_at <= TIMESTAMP '2024-01-21 00:00:00'")
def filt_lookback_upper(spark, sf_dir):
    return T.filter_lookback(fixture(spark, sf_dir, "invitees"), "created_at", 15,
                             dt.datetime(2024, 1, 21), upper=True).select("uri", "created_at")


@register("filt_event_types", sql_with(("bookings",)) +
          f"SELECT uri, event_type FROM bookings WHERE event_type IN ({', '.join(duck.q(t) for t in TARGET_TYPES)})")
def filt_event_types(spark, sf_dir):
    return T.filter_event_types(fixture(spark, sf_dir, "bookings"), TARGET_TYPES).select("uri", "event_type")


@register("filt_channel", sql_with(("leads",)) +
          "SELECT item_id, owner, utm_source FROM leads WHERE utm_source = 'google-ads'")
def filt_channel(spark, sf_dir):
    return T.filter_equals(fixture(spark, sf_dir, "leads"), "utm_source", "google-ads").select(
        "item_id", "owner", "utm_source")


@register("filt_origin", sql_leads_origin_with() +
          "SELECT item_id, owner, origin FROM leads_origin WHERE origin = 'cold-email'")
def filt_origin(spark, sf_dir):
    return T.filter_equals(leads_with_origin(spark, sf_dir), "origin", "cold-email").select(
        "item_id", "owner", "origin")


_MEMBERSHIP_SQL = ("SELECT 'events/' || CAST(event_id AS STRING) AS uri, "
                   "'users/' || CAST(user_id % 80 AS STRING) AS host FROM events")


def _bookings_with_members(spark, sf_dir):
    from leadflow.plans.fixtures import base_table
    ev = base_table(spark, sf_dir, "events")
    hosts = ev.select(F.concat(F.lit("events/"), F.col("event_id").cast("string")).alias("uri"),
                      F.array(F.struct(F.concat(F.lit("users/"), (F.col("user_id") % 80).cast("string"))
                                       .alias("user"))).alias("event_memberships"))
    return fixture(spark, sf_dir, "bookings").join(hosts, "uri")


@register("filt_user_events", sql_with(("bookings",)) +
          f"SELECT b.uri, b.status FROM bookings b JOIN ({_MEMBERSHIP_SQL}) m ON b.uri = m.uri WHERE m.host = 'users/7'")
def filt_user_events(spark, sf_dir):
    return T.filter_user_events(_bookings_with_members(spark, sf_dir), "users/7").select("uri", "status")


@register("set_union_status", sql_with(("bookings",)) +
          "SELECT uri, status FROM bookings WHERE status = 'active' UNION ALL "
          "SELECT uri, status FROM bookings WHERE status = 'canceled'")
def set_union_status(spark, sf_dir):
    b = fixture(spark, sf_dir, "bookings").select("uri", "status")
    return T.union_status(b.filter("status = 'active'"), b.filter("status = 'canceled'"))


@register("join_event_invitees", sql_with(("bookings", "invitees")) +
          "SELECT i.uri, i.event_uri, b.name AS event_name, i.email FROM invitees i JOIN bookings b ON i.event_uri = b.uri")
def join_event_invitees(spark, sf_dir):
    out = J.event_invitees(fixture(spark, sf_dir, "bookings"), fixture(spark, sf_dir, "invitees"))
    return out.select("uri", "event_uri", "event_name", "email")


@register("agg_stage_counts", sql_with(("leads",)) +
          "SELECT stage, CAST(count(*) AS BIGINT) AS count FROM leads GROUP BY stage")
def agg_stage_counts(spark, sf_dir):
    return A.stage_counts(fixture(spark, sf_dir, "leads"))


@register("agg_value_counts", sql_with(("leads",)) +
          "SELECT owner AS value, CAST(count(*) AS BIGINT) AS count FROM leads WHERE owner IS NOT NULL GROUP BY owner")
def agg_value_counts(spark, sf_dir):
    return A.value_counts(fixture(spark, sf_dir, "leads"), "owner")


@register("topk_events", sql_with(("bookings", "invitees")) +
          "SELECT b.name AS value, CAST(count(*) AS BIGINT) AS count FROM invitees i JOIN bookings b ON i.event_uri = b.uri "
          "GROUP BY b.name ORDER BY count DESC, value ASC LIMIT 20")
def topk_events(spark, sf_dir):
    inv = J.event_invitees(fixture(spark, sf_dir, "bookings"), fixture(spark, sf_dir, "invitees"))
    return A.value_counts(inv, "event_name", 20)


@register("win_newest_per_key", sql_with(("leads",)) +
          "SELECT email, item_id, stage, deal_value, seq FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY seq DESC) AS rn FROM leads) t WHERE rn = 1")
def win_newest_per_key(spark, sf_dir):
    """The newest lead of each e-mail."""
    return J.newest_per_key(fixture(spark, sf_dir, "leads").select("email", "item_id", "stage", "deal_value", "seq"), "email", "seq")


@register("topk_lead_emails", sql_with(("leads",)) +
          "SELECT email AS value, CAST(count(*) AS BIGINT) AS count FROM leads WHERE email IS NOT NULL GROUP BY email ORDER BY count DESC, value ASC LIMIT 25")
def topk_lead_emails(spark, sf_dir):
    """The busiest e-mails, without shuffling every e-mail."""
    return B.top_values(fixture(spark, sf_dir, "leads"), "email", 25)


@register("agg_deal_quantiles", sql_with(("leads",)) +
          f"SELECT round(quantile_cont(v, 0.25), 6) AS lower_quarter, round(median(v), 6) AS median, round(quantile_cont(v, 0.9), 6) AS upper_tenth "
          f"FROM (SELECT {duck.to_number('deal_value')} AS v FROM leads WHERE stage = 'won') t")
def agg_deal_quantiles(spark, sf_dir):
    """Exact quantiles of won deal values by selection, no buffer of all values."""
    won = fixture(spark, sf_dir, "leads").filter("stage = 'won'").select(to_number("deal_value").alias("v"))
    q = B.exact_quantiles(won, "v", [0.25, 0.5, 0.9])
    return literal_table(spark, [tuple(None if v is None else round(v, 6) for v in q)], "lower_quarter double, median double, upper_tenth double")


@register("limit_items", sql_with(("leads",)) +
          "SELECT item_id, item_name FROM leads ORDER BY seq LIMIT 10")
def limit_items(spark, sf_dir):
    return T.first_items(fixture(spark, sf_dir, "leads"), 10, "seq").select("item_id", "item_name")



@register("filt_date_range", sql_with(("leads",)) +
          f"SELECT item_id, date_created FROM leads WHERE {duck.in_range('date_created', '1996-03-01', '1996-09-30')}")
def filt_date_range(spark, sf_dir):
    return T.filter_by_date(fixture(spark, sf_dir, "leads"), "date_created", "1996-03-01", "1996-09-30").select(
        "item_id", "date_created")


@register("set_union_stages", sql_with(("leads",)) +
          "SELECT item_id, stage, deal_value FROM leads WHERE stage = 'won' UNION ALL "
          "SELECT item_id, stage, NULL AS deal_value FROM leads WHERE stage <> 'won'")
def set_union_stages(spark, sf_dir):
    leads = fixture(spark, sf_dir, "leads")
    won = leads.filter("stage = 'won'").select("item_id", "stage", "deal_value")
    others = [leads.filter(F.col("stage") == s).select("item_id", "stage")
              for s in ("scheduled", "unqualified", "cancelled", "noshow", "proposal", "lost")]
    return T.union_stages([won] + others)

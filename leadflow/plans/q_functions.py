"""Registered scalar-function queries (F1-F10) over the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadflow import functions as LF
from leadflow.plans import duck
from leadflow.plans.common import sql_with
from leadflow.plans.fixtures import fixture
from leadflow.plans.registry import register
from leadflow.plans.q_keys import NOW


@register("fn_coerce_date", sql_with(("leads",)) +
          f"SELECT item_id, date_created, CAST({duck.coerce_date('date_created')} AS VARCHAR) AS d, "
          f"CAST({duck.coerce_date('sales_call_date')} AS VARCHAR) AS s FROM leads")
def fn_coerce_date(spark, sf_dir):
    l = fixture(spark, sf_dir, "leads")
    # Dates leave as ISO text so both engines hand over the same value type.
    return l.select("item_id", "date_created", LF.coerce_date("date_created").cast("string").alias("d"),
                    LF.coerce_date("sales_call_date").cast("string").alias("s"))


# Two-digit years up to this one are of its century.
PIVOT_YEAR = 2005


@register("fn_two_digit_years", sql_with(("leads",)) +
          "SELECT item_id, CASE WHEN seq % 5 = 4 THEN NULL ELSE CAST(CAST(DATE '1996-01-01' + CAST(seq % 3000 AS INT) AS DATE) AS VARCHAR) END AS d FROM leads")
def fn_two_digit_years(spark, sf_dir):
    """Dates written with two-digit years in three forms, with four, and (without a pivot) not read."""
    day = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("seq") % 3000).cast("int"))
    form = F.col("seq") % 5
    text = (F.when(form == 0, F.date_format(day, "M/d/yy")).when(form == 1, F.date_format(day, "d-MMM-yy"))
            .when(form == 2, F.concat(F.date_format(day, "MMM d, yy"), F.lit(" 09:30"))).otherwise(F.date_format(day, "MM.dd.yyyy")))
    leads = fixture(spark, sf_dir, "leads").select("item_id", "seq", text.alias("t"), F.date_format(day, "MM/dd/yy").alias("short"))
    return leads.select("item_id", F.when(form == 4, LF.coerce_date("short")).otherwise(LF.coerce_date("t", PIVOT_YEAR)).cast("string").alias("d"))


@register("fn_extract_date", sql_with(("leads",)) +
          "SELECT item_id, NULLIF(regexp_extract(date_created, '\\d{4}-\\d{2}-\\d{2}', 0), '') AS d FROM leads")
def fn_extract_date(spark, sf_dir):
    return fixture(spark, sf_dir, "leads").select("item_id", LF.extract_date("date_created").alias("d"))


@register("fn_to_number", sql_with(("leads",)) +
          f"SELECT item_id, deal_value, {duck.to_number('deal_value')} AS amount FROM leads")
def fn_to_number(spark, sf_dir):
    return fixture(spark, sf_dir, "leads").select("item_id", "deal_value",
                                                  LF.to_number("deal_value").alias("amount"))


@register("fn_safe_divide", sql_with(("leads",)) +
          f"SELECT item_id, {duck.safe_divide(duck.to_number('deal_value'), 'seq % 3')} AS q FROM leads")
def fn_safe_divide(spark, sf_dir):
    return fixture(spark, sf_dir, "leads").select(
        "item_id", LF.safe_divide(LF.to_number("deal_value"), F.col("seq") % 3).alias("q"))


@register("fn_rate", sql_with(("leads",)) +
          f"SELECT item_id, {duck.rate('seq % 7', 'seq % 5')} AS r, "
          f"{duck.safe_divide(duck.to_number('deal_value'), 'seq % 4')} AS per FROM leads")
def fn_rate(spark, sf_dir):
    return fixture(spark, sf_dir, "leads").select(
        "item_id", LF.rate(F.col("seq") % 7, F.col("seq") % 5).alias("r"),
        LF.revenue_per(LF.to_number("deal_value"), F.col("seq") % 4).alias("per"))


@register("fn_calendar", sql_with(("invitees",)) +
          f"SELECT uri, {duck.month_of('created_at')} AS month, {duck.weekday_of('created_at')} AS weekday FROM invitees")
def fn_calendar(spark, sf_dir):
    return fixture(spark, sf_dir, "invitees").select(
        "uri", LF.month_of("created_at").alias("month"), LF.weekday_of("created_at").alias("weekday"))


@register("fn_uri_tail", sql_with(("invitees",)) +
          f"SELECT uri, {duck.uri_tail('uri')} AS tail, {duck.uri_tail('event_uri')} AS event_id FROM invitees")
def fn_uri_tail(spark, sf_dir):
    return fixture(spark, sf_dir, "invitees").select(
        "uri", LF.uri_tail("uri").alias("tail"), LF.uri_tail("event_uri").alias("event_id"))


@register("fn_key_hash", sql_with(("api_keys",)) +
          "SELECT plain_key, sha256(plain_key) AS key_hash, substr(sha256(plain_key), 1, 8) AS key_id FROM api_keys")
def fn_key_hash(spark, sf_dir):
    k = fixture(spark, sf_dir, "api_keys")
    return k.select("plain_key", LF.key_hash("plain_key").alias("key_hash"),
                    LF.key_id(LF.key_hash("plain_key")).alias("key_id"))


@register("fn_key_valid", sql_with(("api_keys",)) +
          "SELECT plain_key, coalesce(TIMESTAMP '2024-02-15 00:00:00' > expires_at, false) AS expired, "
          "is_active AND NOT coalesce(TIMESTAMP '2024-02-15 00:00:00' > expires_at, false) AS valid FROM api_keys")
def fn_key_valid(spark, sf_dir):
    k = fixture(spark, sf_dir, "api_keys")
    return k.select("plain_key", LF.is_expired("expires_at", NOW).alias("expired"),
                    LF.is_valid("is_active", "expires_at", NOW).alias("valid"))


@register("fn_run_timestamp", sql_with(("request_log",)) +
          "SELECT request_id, 'combined_output_' || strftime(ts, '%Y%m%d_%H%M%S') || '.csv' AS file_name, "
          "CAST(date_trunc('second', ts) AS TIMESTAMP) AS run_ts FROM request_log")
def fn_run_timestamp(spark, sf_dir):
    r = fixture(spark, sf_dir, "request_log")
    name = F.concat(F.lit("combined_output_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".csv"))
    return r.select("request_id", name.alias("file_name"),
                    LF.run_timestamp_from_name(name).cast("timestamp_ntz").alias("run_ts"))

"""Shared building blocks of the registered queries (Spark and SQL side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.operators import joins, transform
from leadflow.plans import duck
from leadflow.plans.fixtures import FIXTURE_TYPE_ORIGINS, duck_fixture_cte, fixture

# Report window used by the KPI queries over the fixture (orders 1995-2001).
START, END = "1995-06-01", "1998-06-30"
DATE_COL = "date_created"

TARGET_TYPES = [t for ts in FIXTURE_TYPE_ORIGINS.values() for t in ts]


def typed_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings of the target event types with their origin label."""
    b = transform.filter_event_types(fixture(spark, sf_dir, "bookings"), TARGET_TYPES)
    return transform.tag_event_origin(b, FIXTURE_TYPE_ORIGINS)


def enriched_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed bookings left-joined to their first invitee."""
    return joins.enrich_first_invitee(typed_bookings(spark, sf_dir),
                                      fixture(spark, sf_dir, "invitees"))


def leads_with_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.annotate_origins(fixture(spark, sf_dir, "leads"),
                                  enriched_bookings(spark, sf_dir))


# --- SQL twins -------------------------------------------------------------

def _in_list(vals) -> str:
    return ", ".join(duck.q(v) for v in vals)


SQL_ORIGIN_CASE = ("CASE " + " ".join(
    f"WHEN event_type IN ({_in_list(ts)}) THEN {duck.q(o)}"
    for o, ts in reversed(list(FIXTURE_TYPE_ORIGINS.items()))) + " END")

SQL_TYPED_BOOKINGS = f"""typed_bookings AS (
  SELECT *, {SQL_ORIGIN_CASE} AS origin FROM bookings WHERE event_type IN ({_in_list(TARGET_TYPES)})
)"""

SQL_FIRST_INVITEE = """first_invitee AS (
  SELECT event_uri, invitee_name, invitee_email FROM (
    SELECT event_uri, name AS invitee_name, email AS invitee_email,
           row_number() OVER (PARTITION BY event_uri ORDER BY CASE status WHEN 'active' THEN 1 ELSE 2 END, pos, name, email) AS rn
    FROM invitees WHERE status IN ('active', 'canceled')) t WHERE rn = 1
)"""

SQL_ENRICHED = """enriched_bookings AS (
  SELECT b.*, f.invitee_name, f.invitee_email FROM typed_bookings b LEFT JOIN first_invitee f ON b.uri = f.event_uri
)"""

SQL_LEADS_ORIGIN = """best_origin AS (
  SELECT invitee_email AS e, max(CASE origin WHEN 'cold-email' THEN 2 WHEN 'cold-calling' THEN 1 END) AS p
  FROM enriched_bookings WHERE invitee_email IS NOT NULL AND origin IS NOT NULL GROUP BY invitee_email
),
leads_origin AS (
  SELECT l.*, coalesce(CASE b.p WHEN 2 THEN 'cold-email' WHEN 1 THEN 'cold-calling' END, 'LinkedIn') AS origin
  FROM leads l LEFT JOIN best_origin b ON l.email = b.e
)"""


def sql_with(fixtures: tuple, *ctes: str) -> str:
    """``WITH`` clause: fixture CTEs followed by extra CTE texts."""
    head = duck_fixture_cte(*fixtures)
    if ctes:
        head = head.rstrip("\n") + ",\n" + ",\n".join(ctes) + "\n"
    return head


def sql_leads_origin_with(*extra: str) -> str:
    return sql_with(("leads", "bookings", "invitees"), SQL_TYPED_BOOKINGS,
                    SQL_FIRST_INVITEE, SQL_ENRICHED, SQL_LEADS_ORIGIN, *extra)

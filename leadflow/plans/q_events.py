"""Registered event-type, invitee and Q&A queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadflow.operators import analytics as A
from leadflow.operators import joins as J
from leadflow.operators import transform as T
from leadflow.plans import duck
from leadflow.plans.fixtures import fixture
from leadflow.plans.registry import register
from leadflow.plans.common import sql_with
from leadflow.schemas import TRACKING_FIELDS
from leadflow.sources import pages as S

# --- typed event types (P10 + S8 owner columns) -----------------------------


def typed_event_types(spark, sf_dir):
    et = fixture(spark, sf_dir, "event_types").withColumnRenamed("owner_type", "source")
    et = T.type_event_frame(et)
    return J.user_event_types_left(fixture(spark, sf_dir, "members"), et)


SQL_TYPED_TYPES = f"""typed_types AS (
  SELECT t.uri, t.name, coalesce(t.active, false) AS active, t.type, t.kind,
         coalesce(TRY_CAST(trunc({duck.to_number('t.duration')}) AS INTEGER), 0) AS duration,
         t.owner_type AS source, t.owner_uri,
         timezone('UTC', TRY_CAST(t.created_at AS TIMESTAMPTZ)) AS created_at, timezone('UTC', TRY_CAST(t.updated_at AS TIMESTAMPTZ)) AS updated_at,
         m.name AS owner_name, m.email AS owner_email
  FROM event_types t LEFT JOIN members m ON t.owner_uri = m.user_uri
)"""

_TYPES_WITH = sql_with(("event_types", "members"), SQL_TYPED_TYPES)


@register("proj_event_frame", _TYPES_WITH +
          "SELECT uri, active, duration, created_at, updated_at FROM typed_types")
def proj_event_frame(spark, sf_dir):
    return T.type_event_frame(fixture(spark, sf_dir, "event_types")).select(
        "uri", "active", "duration", "created_at", "updated_at")


@register("set_union_event_types", sql_with(("event_types",)) +
          "SELECT uri, 'organization' AS source FROM event_types WHERE owner_type = 'organization' UNION ALL "
          "SELECT uri, 'user' AS source FROM event_types WHERE owner_type = 'user' UNION ALL "
          "SELECT uri, 'user' AS source FROM event_types WHERE owner_type = 'organization' AND uri LIKE '%0'")
def set_union_event_types(spark, sf_dir):
    et = fixture(spark, sf_dir, "event_types")
    org = et.filter("owner_type = 'organization'").select("uri")
    # The same type listed under a user as well counts twice (bag union).
    user = et.filter("owner_type = 'user' OR (owner_type = 'organization' AND uri LIKE '%0')").select("uri")
    return T.union_event_types(org, user)


@register("join_user_event_types", sql_with(("event_types", "members")) +
          "SELECT t.uri, t.owner_uri, m.name AS owner_name, m.email AS owner_email FROM event_types t "
          "JOIN members m ON t.owner_uri = m.user_uri")
def join_user_event_types(spark, sf_dir):
    return J.user_event_types(fixture(spark, sf_dir, "members"), fixture(spark, sf_dir, "event_types")).select(
        "uri", "owner_uri", "owner_name", "owner_email")


@register("join_members_semi", sql_with(("event_types", "members")) +
          "SELECT user_uri, name FROM members m WHERE EXISTS (SELECT 1 FROM event_types t WHERE t.owner_uri = m.user_uri)")
def join_members_semi(spark, sf_dir):
    return J.members_with_types(fixture(spark, sf_dir, "members"), fixture(spark, sf_dir, "event_types")).select(
        "user_uri", "name")


@register("join_members_anti", sql_with(("event_types", "members")) +
          "SELECT user_uri, name FROM members m WHERE NOT EXISTS (SELECT 1 FROM event_types t WHERE t.owner_uri = m.user_uri)")
def join_members_anti(spark, sf_dir):
    return J.members_without_types(fixture(spark, sf_dir, "members"), fixture(spark, sf_dir, "event_types")).select(
        "user_uri", "name")


@register("agg_member_coverage", sql_with(("event_types", "members")) +
          "SELECT CAST(count(*) AS BIGINT) AS total_members, CAST(count_if(h) AS BIGINT) AS members_with_types, "
          "CAST(count(*) - count_if(h) AS BIGINT) AS members_without_types, "
          "round(coalesce(count_if(h) * 100.0 / NULLIF(count(*), 0), 0.0), 2) AS success_rate FROM "
          "(SELECT m.user_uri, EXISTS (SELECT 1 FROM event_types t WHERE t.owner_uri = m.user_uri) AS h FROM members m) x")
def agg_member_coverage(spark, sf_dir):
    return J.member_type_coverage(fixture(spark, sf_dir, "members"), fixture(spark, sf_dir, "event_types"))


@register("agg_event_stats", _TYPES_WITH +
          "SELECT CAST(count(*) AS BIGINT) AS total_events, CAST(count_if(active) AS BIGINT) AS active_events, "
          "CAST(count(*) - count_if(active) AS BIGINT) AS inactive_events, "
          "CAST(count_if(source = 'organization') AS BIGINT) AS organization_events, "
          "CAST(count_if(source = 'user') AS BIGINT) AS user_events, "
          "CAST(count(DISTINCT owner_name) AS BIGINT) AS unique_users, min(duration) AS duration_min, "
          "max(duration) AS duration_max, round(avg(duration), 9) AS duration_mean, "
          "CAST(median(duration) AS DOUBLE) AS duration_median, round(stddev_samp(duration), 9) AS duration_std, "
          "min(created_at) AS earliest_created, max(created_at) AS latest_created, min(updated_at) AS earliest_updated, max(updated_at) AS latest_updated FROM typed_types")
def agg_event_stats(spark, sf_dir):
    return A.event_statistics(typed_event_types(spark, sf_dir))


def _sql_counts(dim, src, col, n=None):
    lim = f" ORDER BY count DESC, value ASC LIMIT {n}" if n else ""
    return (f"SELECT * FROM (SELECT '{dim}' AS dimension, CAST({col} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS count "
            f"FROM {src} WHERE {col} IS NOT NULL GROUP BY {col}{lim})")


@register("agg_event_distributions", _TYPES_WITH + " UNION ALL ".join([
    _sql_counts("kind", "typed_types", "kind"), _sql_counts("type", "typed_types", "type"),
    _sql_counts("source", "typed_types", "source"), _sql_counts("top_users", "typed_types", "owner_name", 10)]))
def agg_event_distributions(spark, sf_dir):
    return A.event_distributions(typed_event_types(spark, sf_dir))


@register("strategy_event_types", _TYPES_WITH +
          "SELECT uri, source, owner_uri, CASE WHEN source = 'organization' THEN NULL ELSE owner_name END AS owner_name "
          "FROM typed_types")
def strategy_event_types(spark, sf_dir):
    et = fixture(spark, sf_dir, "event_types")
    members = fixture(spark, sf_dir, "members")
    org = S.extract_event_types(et.filter("owner_type = 'organization'"), "organization", members=members)
    usr = S.extract_event_types(et.filter("owner_type = 'user'"), "user", members=members)
    return T.union_stages([org, usr]).select("uri", "source", "owner_uri", "owner_name")


# --- invitees --------------------------------------------------------------

def named_invitees(spark, sf_dir):
    return J.event_invitees(fixture(spark, sf_dir, "bookings"), fixture(spark, sf_dir, "invitees"))


_INV_WITH = sql_with(("bookings", "invitees"),
                     "inv AS (SELECT i.*, b.name AS event_name FROM invitees i JOIN bookings b ON i.event_uri = b.uri)")


@register("agg_invitee_summary", sql_with(("invitees",)) +
          "SELECT CAST(count(*) AS BIGINT) AS total_invitees, CAST(count(DISTINCT event_uri) AS BIGINT) AS unique_events, "
          "CAST(count(DISTINCT email) AS BIGINT) AS unique_invitees, min(created_at) AS earliest_booking, "
          "max(created_at) AS latest_booking FROM invitees")
def agg_invitee_summary(spark, sf_dir):
    return A.invitee_summary(fixture(spark, sf_dir, "invitees"))


@register("agg_invitee_distributions", _INV_WITH + " UNION ALL ".join([
    _sql_counts("status", "inv", "status"), _sql_counts("event_popularity", "inv", "event_name", 20),
    _sql_counts("timezone", "inv", "timezone", 10)]))
def agg_invitee_distributions(spark, sf_dir):
    return A.invitee_distributions(named_invitees(spark, sf_dir))


@register("agg_bookings_by_month", sql_with(("invitees",)) +
          f"SELECT {duck.month_of('created_at')} AS month, CAST(count(*) AS BIGINT) AS count FROM invitees "
          "WHERE created_at IS NOT NULL GROUP BY 1 ORDER BY 1")
def agg_bookings_by_month(spark, sf_dir):
    return A.bookings_by_month(fixture(spark, sf_dir, "invitees"))


@register("agg_bookings_by_weekday", sql_with(("invitees",)) +
          f"SELECT {duck.weekday_of('created_at')} AS weekday, CAST(count(*) AS BIGINT) AS count FROM invitees "
          "WHERE created_at IS NOT NULL GROUP BY 1")
def agg_bookings_by_weekday(spark, sf_dir):
    return A.bookings_by_weekday(fixture(spark, sf_dir, "invitees"))


def tracked_invitees(spark, sf_dir):
    """Invitees in their landed shape (nested tracking), then flattened."""
    inv = fixture(spark, sf_dir, "invitees")
    nested = inv.select("uri", "event_uri", F.struct(*[
        (F.col(f) if f in inv.columns else F.lit(None).cast("string")).alias(f)
        for f in TRACKING_FIELDS]).alias("tracking"))
    return T.flatten_tracking(nested)


@register("proj_tracking", sql_with(("invitees",)) +
          "SELECT uri, coalesce(utm_source, '') AS utm_source, coalesce(utm_medium, '') AS utm_medium, "
          "coalesce(utm_campaign, '') AS utm_campaign, '' AS utm_term, '' AS utm_content, '' AS salesforce_uuid FROM invitees")
def proj_tracking(spark, sf_dir):
    return tracked_invitees(spark, sf_dir).drop("event_uri")


@register("agg_invitee_utm", sql_with(("invitees",)) + " UNION ALL ".join([
    _sql_counts("sources", "(SELECT coalesce(utm_source, '') AS utm_source FROM invitees)", "utm_source"),
    _sql_counts("campaigns", "(SELECT coalesce(utm_campaign, '') AS utm_campaign FROM invitees)", "utm_campaign"),
    _sql_counts("mediums", "(SELECT coalesce(utm_medium, '') AS utm_medium FROM invitees)", "utm_medium")]))
def agg_invitee_utm(spark, sf_dir):
    return A.invitee_utm(tracked_invitees(spark, sf_dir))


# --- Q&A -------------------------------------------------------------------

def qa_nested(spark, sf_dir):
    """Per conversation, the Q&A array in turn order (the landed shape)."""
    qa = fixture(spark, sf_dir, "qa")
    return (qa.groupBy("conv_id")
              .agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))).alias("_qa"))
              .select("conv_id", F.transform("_qa", lambda x: F.struct(
                  x["question"].alias("question"), x["answer"].alias("answer"))).alias("questions_and_answers")))


SQL_QA_LONG = ("qa_long AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position, "
               "question, answer FROM qa)")
_QA_WITH = sql_with(("qa",), SQL_QA_LONG)


@register("proj_qa_long", _QA_WITH + "SELECT conv_id, position, question, answer FROM qa_long")
def proj_qa_long(spark, sf_dir):
    return T.explode_qa(qa_nested(spark, sf_dir), "conv_id")


# The oracle's columns are fixed: conversations of the test tables have up to 8 turns.
# The query gives as many as the longest needs, at least these.
QA_WIDE_N = 8


@register("proj_qa_wide", _QA_WITH + "SELECT conv_id, " + ", ".join(
    f"max(CASE WHEN position = {j} THEN question END) AS question_{j}, max(CASE WHEN position = {j} THEN answer END) AS answer_{j}"
    for j in range(1, QA_WIDE_N + 1)) + " FROM qa_long GROUP BY conv_id")
def proj_qa_wide(spark, sf_dir):
    nested = qa_nested(spark, sf_dir)
    return T.flatten_qa(nested, max(QA_WIDE_N, T.max_qa_count(nested)))


_QA_FIRST = ("per_pos AS (SELECT question, position, count(*) AS n FROM qa_long WHERE question IS NOT NULL AND question <> '' "
             "GROUP BY question, position), first_pos AS (SELECT question, min(position) AS p FROM per_pos GROUP BY question)")


@register("agg_question_counts", sql_with(("qa",), SQL_QA_LONG, _QA_FIRST) +
          "SELECT f.question, f.p AS first_position, CAST(pp.n AS BIGINT) AS count FROM first_pos f "
          "JOIN per_pos pp ON f.question = pp.question AND f.p = pp.position")
def agg_question_counts(spark, sf_dir):
    return A.question_counts(T.explode_qa(qa_nested(spark, sf_dir), "conv_id"))


@register("agg_question_total", sql_with(("qa",), SQL_QA_LONG, _QA_FIRST) +
          "SELECT CAST(count(*) AS BIGINT) AS total_unique_questions FROM first_pos")
def agg_question_total(spark, sf_dir):
    return A.question_total(T.explode_qa(qa_nested(spark, sf_dir), "conv_id"))


@register("agg_question_answers", sql_with(("qa",), SQL_QA_LONG, _QA_FIRST) +
          "SELECT l.question, l.answer, CAST(count(*) AS BIGINT) AS count FROM qa_long l JOIN first_pos f "
          "ON l.question = f.question AND l.position = f.p WHERE l.answer IS NOT NULL GROUP BY l.question, l.answer")
def agg_question_answers(spark, sf_dir):
    return A.question_answers(T.explode_qa(qa_nested(spark, sf_dir), "conv_id"))


# --- members and summaries ---------------------------------------------------

@register("proj_member_export", sql_with(("members",)) +
          "SELECT user_uri, name, email, role, status FROM members")
def proj_member_export(spark, sf_dir):
    return T.project_subset(fixture(spark, sf_dir, "members"), T.MEMBER_EXPORT_FIELDS)


@register("proj_member_summary", sql_with(("members",)) + "SELECT name, email, role, status FROM members")
def proj_member_summary(spark, sf_dir):
    return T.project_subset(fixture(spark, sf_dir, "members"), T.MEMBER_SUMMARY_FIELDS)


@register("agg_extraction_summary", _TYPES_WITH +
          "SELECT CAST(count_if(source = 'organization') AS BIGINT) AS total_organization_events, "
          "CAST(count_if(source = 'user') AS BIGINT) AS total_user_events, "
          "(SELECT CAST(count(*) AS BIGINT) FROM members) AS total_members, "
          "CAST(count_if(active) AS BIGINT) AS active_events, CAST(count_if(NOT active) AS BIGINT) AS inactive_events, "
          "CAST(count(*) AS BIGINT) AS total_events FROM typed_types")
def agg_extraction_summary(spark, sf_dir):
    return A.extraction_summary(typed_event_types(spark, sf_dir), fixture(spark, sf_dir, "members"))


@register("agg_invitee_counts", sql_with(("bookings", "invitees")) +
          "SELECT (SELECT CAST(count(*) AS BIGINT) FROM bookings) AS total_events, (SELECT CAST(count(*) AS BIGINT) FROM invitees) AS total_invitees")
def agg_invitee_counts(spark, sf_dir):
    """The counts of `agg_invitee_extraction`; its JSON size has no SQL twin."""
    return agg_invitee_extraction(spark, sf_dir).select("total_events", "total_invitees")


@register("agg_invitee_size", sql_with(("bookings", "invitees")) +
          "SELECT (SELECT CAST(count(*) AS BIGINT) FROM bookings) AS total_events, (SELECT CAST(count(*) AS BIGINT) FROM invitees) AS total_invitees, "
          "round(((SELECT sum(strlen(CAST(to_json({'uri': uri, 'name': name, 'status': status, 'event_type': event_type}) AS VARCHAR))) FROM bookings) + "
          "(SELECT sum(strlen(CAST(to_json({'event_uri': event_uri, 'uri': uri, 'status': status, 'name': name, 'timezone': timezone}) AS VARCHAR))) FROM invitees)) "
          "/ 1048576.0, 2) AS data_size_mb")
def agg_invitee_size(spark, sf_dir):
    """Counts and JSON size over the columns that both engines write alike."""
    return A.invitee_extraction_summary(fixture(spark, sf_dir, "bookings").select("uri", "name", "status", "event_type"),
                                        fixture(spark, sf_dir, "invitees").select("event_uri", "uri", "status", "name", "timezone"))


@register("agg_invitee_extraction")
def agg_invitee_extraction(spark, sf_dir):
    return A.invitee_extraction_summary(fixture(spark, sf_dir, "bookings"), fixture(spark, sf_dir, "invitees"))

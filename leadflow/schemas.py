"""Schemas and fixed lookup values of the funnel data model."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the source system's configuration.
# Board group id -> funnel stage name (seven stages).
STAGE_BY_GROUP = {
    "topics": "scheduled",
    "new_group34578__1": "unqualified",
    "new_group27351__1": "won",
    "new_group54376__1": "cancelled",
    "new_group64021__1": "noshow",
    "new_group65903__1": "proposal",
    "new_group62617__1": "lost",
}

# Board column id -> column title (28 entries; unknown ids keep their id).
TITLE_BY_COLUMN_ID = {
    "name": "Name",
    "auto_number__1": "Auto number",
    "person": "Owner",
    "last_updated__1": "Last updated",
    "link__1": "Linkedin",
    "phone__1": "Phone",
    "email__1": "Email",
    "text7__1": "Company",
    "date4": "Sales Call Date",
    "status9__1": "Follow Up Tracker",
    "notes__1": "Notes",
    "interested_in__1": "Interested In",
    "status4__1": "Plan Type",
    "numbers__1": "Deal Value",
    "status6__1": "Email Template #1",
    "dup__of_email_template__1": "Email Template #2",
    "status__1": "Deal Status",
    "status2__1": "Send Panda Doc?",
    "utm_source__1": "UTM Source",
    "date__1": "Deal Status Date",
    "utm_campaign__1": "UTM Campaign",
    "utm_medium__1": "UTM Medium",
    "utm_content__1": "UTM Content",
    "link3__1": "UTM LINK",
    "lead_source8__1": "Lead Source",
    "color__1": "Channel FOR FUNNEL METRICS",
    "subitems__1": "Subitems",
    "date5__1": "Date Created",
}

# Stage order used for first-seen key order in reports.
STAGE_ORDER = ("cancelled", "lost", "noshow", "proposal", "scheduled",
               "unqualified", "won")
# Stage sets of the KPI reports.
BOOKED_STAGES = STAGE_ORDER
TAKEN_STAGES = ("unqualified", "proposal", "won", "lost")
PROPOSAL_STAGES = ("proposal", "won", "lost")

# Origin labels and their precedence (higher wins when an e-mail has several).
ORIGIN_COLD_EMAIL = "cold-email"
ORIGIN_COLD_CALLING = "cold-calling"
ORIGIN_LINKEDIN = "LinkedIn"
ORIGIN_PRECEDENCE = {ORIGIN_COLD_CALLING: 1, ORIGIN_COLD_EMAIL: 2}
# ---------------------------------------------------------------------------

_SNAKE_OVERRIDES = {"Channel FOR FUNNEL METRICS": "channel"}


def snake(title: str) -> str:
    """Title -> snake_case column name used by this library."""
    if title in _SNAKE_OVERRIDES:
        return _SNAKE_OVERRIDES[title]
    return re.sub(r"[^0-9a-z]+", "_", title.lower()).strip("_")


# Column id -> canonical snake_case lead column.
LEAD_COLUMN_BY_ID = {cid: snake(t) for cid, t in TITLE_BY_COLUMN_ID.items()}

LEAD_COLUMNS = ["item_id", "item_name"] + list(LEAD_COLUMN_BY_ID.values())

# ---------------------------------------------------------------------------
# Landed page schemas (explicit: no inference pass over the files). Their field names,
# PROFILE_FIELDS and TRACKING_FIELDS included, are those of the API bodies that are read.
COLUMN_VALUE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
])
BOARD_ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("column_values", T.ArrayType(COLUMN_VALUE)),
])
_ITEMS_PAGE = T.StructType([
    T.StructField("cursor", T.StringType()),
    T.StructField("items", T.ArrayType(BOARD_ITEM)),
])
_ERRORS = T.ArrayType(T.StructType([T.StructField("message", T.StringType())]))
BOARD_PAGE = T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("boards", T.ArrayType(T.StructType([
            T.StructField("groups", T.ArrayType(T.StructType([
                T.StructField("id", T.StringType()),
                T.StructField("title", T.StringType()),
                T.StructField("items_page", _ITEMS_PAGE),
            ]))),
        ]))),
        T.StructField("next_items_page", _ITEMS_PAGE),
    ])),
    T.StructField("errors", _ERRORS),
])

PAGINATION = T.StructType([T.StructField("next_page", T.StringType())])


def collection_page(row: T.StructType) -> T.StructType:
    """``{collection:[row], pagination:{next_page}}`` page schema."""
    return T.StructType([
        T.StructField("collection", T.ArrayType(row)),
        T.StructField("pagination", PAGINATION),
        T.StructField("error", T.StringType()),
    ])


USER = T.StructType([T.StructField(n, T.StringType()) for n in
                     ("name", "email", "uri")])
MEMBERSHIP_ROW = T.StructType([
    T.StructField("user", USER),
    T.StructField("role", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("organization", T.StringType()),
    T.StructField("uri", T.StringType()),
])
PROFILE_FIELDS = ("name", "email", "uri", "timezone", "scheduling_url",
                  "created_at", "updated_at", "current_organization",
                  "resource_type")
PROFILE_PAGE = T.StructType([
    T.StructField("resource", T.StructType(
        [T.StructField(n, T.StringType()) for n in PROFILE_FIELDS])),
])
EVENT_TYPE_ROW = T.StructType([
    T.StructField("uri", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("type", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("slug", T.StringType()),
    T.StructField("duration", T.StringType()),
    T.StructField("description_plain", T.StringType()),
    T.StructField("scheduling_url", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("internal_note", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("profile", T.StructType([
        T.StructField("owner", T.StringType()),
        T.StructField("name", T.StringType()),
    ])),
])
MEMBERSHIP_REF = T.StructType([T.StructField("user", T.StringType())])
GUEST = T.StructType([
    T.StructField("email", T.StringType()),
    T.StructField("created_at", T.StringType()),
])
SCHEDULED_EVENT_ROW = T.StructType([
    T.StructField("uri", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("end_time", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("location", T.MapType(T.StringType(), T.StringType())),
    T.StructField("invitees_counter", T.MapType(T.StringType(), T.StringType())),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("event_memberships", T.ArrayType(MEMBERSHIP_REF)),
    T.StructField("event_guests", T.ArrayType(GUEST)),
])
QA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("position", T.IntegerType()),
])
TRACKING_FIELDS = ("utm_source", "utm_medium", "utm_campaign", "utm_term",
                   "utm_content", "salesforce_uuid")
TRACKING = T.StructType([T.StructField(n, T.StringType()) for n in TRACKING_FIELDS])
INVITEE_ROW = T.StructType([
    T.StructField("uri", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("questions_and_answers", T.ArrayType(QA)),
    T.StructField("timezone", T.StringType()),
    T.StructField("text_reminder_number", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("scheduled_event", T.StringType()),
    T.StructField("scheduling_url", T.StringType()),
    T.StructField("cancel_url", T.StringType()),
    T.StructField("reschedule_url", T.StringType()),
    T.StructField("tracking", TRACKING),
])

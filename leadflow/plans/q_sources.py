"""Registered source, board-item and sink queries.

Each one lands fixture rows in the API's page shape (or writes a snapshot)
under the shared checkpoint folder with Spark, reads them back with the
library's reader and returns the typed rows; the oracle computes the same
rows straight from the fixture.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from leadflow.operators import joins as J
from leadflow.operators import kpi as K
from leadflow.operators import transform as T
from leadflow.plans import duck
from leadflow.plans.common import sql_leads_origin_with, sql_with
from leadflow.plans.fixtures import fixture
from leadflow.plans.landing import (BOARD_COLUMNS, GROUP_OF_STAGE, TITLE_ID, land_board_groups,
                                    land_board_pages, land_collection, landed_once)
from leadflow.plans.registry import register
from leadflow.schemas import (EVENT_TYPE_ROW, INVITEE_ROW, LEAD_COLUMN_BY_ID, MEMBERSHIP_ROW,
                              SCHEDULED_EVENT_ROW, STAGE_BY_GROUP)
from leadflow.session import scratch_path
from leadflow.sinks import session as SS
from leadflow.sinks import writers as W
from leadflow.sources import document as DOC
from leadflow.sources import pages as S
from leadflow.sources import snapshots as SN

ISO_SPARK = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
ISO_DUCK = "%Y-%m-%dT%H:%M:%S.%fZ"

# --- bookings pages (S3, S4, S6) ---------------------------------------------


def _land_bookings(spark, sf_dir):
    return landed_once(spark, sf_dir, "bookings-pages", lambda: _land_bookings_now(spark, sf_dir))


def _land_bookings_now(spark, sf_dir):
    b = fixture(spark, sf_dir, "bookings").withColumn("_id", F.substring_index("uri", "/", -1).cast("long"))
    page = F.floor(F.col("_id") / 100) + 1
    row = F.struct("uri", "name", "status", F.date_format("start_time", ISO_SPARK).alias("start_time"), "event_type")
    err = F.when((F.col("stream") == "canceled") & (F.col("page") % 7 == 3), F.lit("HTTP 500"))
    path = scratch_path(spark, "bookings-pages")
    land_collection(b, path, F.col("status"), page, F.col("_id"), row, error=err)
    return path


SQL_BOOKING_PAGES = ("bpages AS (SELECT status AS stream, CAST(substr(uri, 8) AS BIGINT) // 100 + 1 AS page, "
                     "CAST(substr(uri, 8) AS BIGINT) AS id, uri, name, status, event_type, "
                     f"strftime(start_time, '{ISO_DUCK}') AS start_time FROM bookings), "
                     "brows AS (SELECT *, CAST(row_number() OVER (PARTITION BY stream, page ORDER BY id) AS INTEGER) AS pos, "
                     "(stream = 'canceled' AND page % 7 = 3) AS err FROM bpages)")


@register("src_collection_pages", sql_with(("bookings",), SQL_BOOKING_PAGES) +
          "SELECT stream, page, pos, uri, name, status, start_time, event_type FROM brows WHERE NOT err")
def src_collection_pages(spark, sf_dir):
    path = _land_bookings(spark, sf_dir)
    rows = S.read_collection_rows(spark, path, SCHEDULED_EVENT_ROW, stop_at_error=False)
    return rows.select("stream", "page", "pos", "uri", "name", "status", "start_time", "event_type")


@register("src_page_prefix", sql_with(("bookings",), SQL_BOOKING_PAGES) +
          "SELECT b.stream, b.page, b.pos, b.uri FROM brows b LEFT JOIN (SELECT stream, min(page) AS fe FROM brows WHERE err "
          "GROUP BY stream) e ON b.stream = e.stream WHERE e.fe IS NULL OR b.page < e.fe")
def src_page_prefix(spark, sf_dir):
    path = _land_bookings(spark, sf_dir)
    return S.read_collection_rows(spark, path, SCHEDULED_EVENT_ROW).select("stream", "page", "pos", "uri")


@register("src_scheduled_events", sql_with(("bookings",), SQL_BOOKING_PAGES) +
          "SELECT uri, name, status, start_time, event_type, '' AS end_time, '' AS created_at, 0 AS n_members "
          "FROM brows WHERE NOT err")
def src_scheduled_events(spark, sf_dir):
    path = _land_bookings(spark, sf_dir)
    ev = S.scheduled_events(S.read_collection_rows(spark, path, SCHEDULED_EVENT_ROW, stop_at_error=False))
    return ev.select("uri", "name", "status", "start_time", "event_type", "end_time", "created_at",
                     F.size("event_memberships").alias("n_members"))


# --- invitee pages (S7) --------------------------------------------------------

@register("src_invitees", sql_with(("bookings", "invitees")) +
          "SELECT i.event_uri, i.uri, coalesce(i.email, '') AS email, i.name, i.status, i.timezone, "
          "'' AS event_type_uri, 'Unknown' AS event_type_name, b.name AS event_name, coalesce(i.utm_source, '') AS utm_source "
          "FROM invitees i LEFT JOIN bookings b ON i.event_uri = b.uri")
def src_invitees(spark, sf_dir):
    inv = fixture(spark, sf_dir, "invitees")
    row = F.struct("uri", "email", "name", "status", "timezone",
                   F.date_format("created_at", ISO_SPARK).alias("created_at"),
                   F.struct("utm_source", "utm_medium", "utm_campaign").alias("tracking"))
    path = scratch_path(spark, "invitee-pages")
    land_collection(inv, path, F.col("event_uri"), F.lit(1), F.col("pos"), row)
    rows = S.read_collection_rows(spark, path, INVITEE_ROW)
    typed = S.invitees(rows, events=fixture(spark, sf_dir, "bookings"))
    return T.flatten_tracking(typed).select("event_uri", "uri", "email", "name", "status", "timezone",
                                            "event_type_uri", "event_type_name", "event_name", "utm_source")


# --- event types, members, profiles (S8-S11) -----------------------------------

@register("src_event_types", sql_with(("event_types", "members")) +
          "SELECT t.uri, t.owner_type AS source, t.owner_uri, m.name AS owner_name, t.active, t.duration, t.kind "
          "FROM event_types t LEFT JOIN members m ON t.owner_uri = m.user_uri AND t.owner_type = 'user'")
def src_event_types(spark, sf_dir):
    et = fixture(spark, sf_dir, "event_types")
    row = F.struct("uri", "name", "active", "type", "kind", "duration", "created_at")
    path = scratch_path(spark, "type-pages")
    land_collection(et, path, F.col("owner_uri"), F.floor(F.substring_index("uri", "/", -1).cast("long") / 100) + 1,
                    F.substring_index("uri", "/", -1).cast("long"), row)
    rows = S.read_collection_rows(spark, path, EVENT_TYPE_ROW)
    org = rows.filter(F.col("stream").startswith("organizations/"))
    usr = rows.filter(~F.col("stream").startswith("organizations/"))
    members = fixture(spark, sf_dir, "members")
    out = T.union_stages([S.extract_event_types(org.withColumnRenamed("stream", "owner_uri"), "organization"),
                          S.extract_event_types(usr, "user", members=members)])
    return out.select("uri", "source", "owner_uri", "owner_name", "active", "duration", "kind")


def _land_members(spark, sf_dir):
    m = fixture(spark, sf_dir, "members")
    sid = F.substring_index("user_uri", "/", -1).cast("long")
    row = F.struct(F.struct("name", "email", F.col("user_uri").alias("uri")).alias("user"), "role", "status",
                   "organization", F.concat(F.lit("memberships/"), sid.cast("string")).alias("uri"))
    path = scratch_path(spark, "member-pages")
    land_collection(m, path, F.lit("org"), F.floor(sid / 20) + 1, sid, row)
    return path


@register("src_members", sql_with(("members",)) +
          "SELECT user_uri, name, email, role, status, organization, 'memberships/' || substr(user_uri, 7) AS membership_uri FROM members")
def src_members(spark, sf_dir):
    return S.members(S.read_collection_rows(spark, _land_members(spark, sf_dir), MEMBERSHIP_ROW)).drop()


def _land_profiles(spark, sf_dir):
    m = fixture(spark, sf_dir, "members")
    res = F.struct("name", "email", F.col("user_uri").alias("uri"), F.lit("UTC").alias("timezone"),
                   F.concat(F.lit("https://cal.example/"), F.substring_index("user_uri", "/", -1)).alias("scheduling_url"),
                   F.lit("2023-01-01T00:00:00Z").alias("created_at"), F.lit("2023-06-01T00:00:00Z").alias("updated_at"),
                   F.concat(F.lit("https://api.example/organizations/"), F.col("organization")).alias("current_organization"),
                   F.lit("User").alias("resource_type"))
    path = scratch_path(spark, "profiles")
    m.select(res.alias("resource")).write.json(path)
    return path


@register("src_user_profile", sql_with(("members",)) +
          "SELECT name, email, user_uri AS uri, 'UTC' AS timezone, 'https://cal.example/' || substr(user_uri, 7) AS scheduling_url, "
          "'2023-01-01T00:00:00Z' AS created_at, '2023-06-01T00:00:00Z' AS updated_at, "
          "'https://api.example/organizations/' || organization AS current_organization, 'User' AS resource_type FROM members")
def src_user_profile(spark, sf_dir):
    return S.read_user_profile(spark, _land_profiles(spark, sf_dir))


@register("src_org_info", sql_with(("members",)) +
          "SELECT 'https://api.example/organizations/' || organization AS organization_uri, organization AS organization_id FROM members")
def src_org_info(spark, sf_dir):
    return S.organization_info(S.read_user_profile(spark, _land_profiles(spark, sf_dir)))


# --- board pages (S1, S2, S5, P1-P3, J7) ---------------------------------------

def _sql_group_case():
    return "CASE stage " + " ".join(f"WHEN {duck.q(s)} THEN {duck.q(g)}" for s, g in GROUP_OF_STAGE.items()) + " END"


def _board_pages(spark, sf_dir):
    return landed_once(spark, sf_dir, "board-pages", lambda: land_board_pages(
        fixture(spark, sf_dir, "leads"), scratch_path(spark, "board-pages")))


SQL_BOARD = (f"bitems AS (SELECT {_sql_group_case()} AS group_id, seq // 50 + 1 AS page, seq, item_id, item_name, "
             + ", ".join(BOARD_COLUMNS) + " FROM leads)")


@register("src_board_items", sql_with(("leads",), SQL_BOARD) +
          "SELECT group_id, page, CAST(row_number() OVER (PARTITION BY group_id, page ORDER BY seq) AS INTEGER) AS pos, item_id AS id, "
          f"item_name AS name, CAST({len(BOARD_COLUMNS)} + CASE WHEN seq % 11 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_values FROM bitems")
def src_board_items(spark, sf_dir):
    path = _board_pages(spark, sf_dir)
    items = S.read_board_items(spark, path)
    return items.select("group_id", "page", "pos", "id", "name", F.size("column_values").alias("n_values"))


@register("proj_items_wide", sql_with(("leads",), SQL_BOARD) +
          "SELECT item_id, item_name, group_id, " + ", ".join(f"{c} AS {TITLE_ID[c]}" for c in BOARD_COLUMNS) + " FROM bitems")
def proj_items_wide(spark, sf_dir):
    path = _board_pages(spark, sf_dir)
    items = S.read_board_items(spark, path)
    return T.items_to_wide(items, keep=("group_id",))


@register("proj_rename", sql_with(("leads",), SQL_BOARD) +
          "SELECT item_id, item_name, " + ", ".join(BOARD_COLUMNS) + " FROM bitems")
def proj_rename(spark, sf_dir):
    path = _board_pages(spark, sf_dir)
    wide = T.items_to_wide(S.read_board_items(spark, path), [TITLE_ID[c] for c in BOARD_COLUMNS])
    return T.rename_columns(wide, LEAD_COLUMN_BY_ID)


@register("proj_tag_stage", sql_with(("leads",)) + "SELECT item_id, stage FROM leads")
def proj_tag_stage(spark, sf_dir):
    path = _board_pages(spark, sf_dir)
    items = S.read_board_items(spark, path).select(F.col("id").alias("item_id"), "group_id")
    return T.tag_stage(items, STAGE_BY_GROUP).select("item_id", "stage")


@register("src_page_errors", sql_with(("leads",), SQL_BOARD) +
          "SELECT DISTINCT group_id AS stream, page, 'complexity budget exhausted on page ' || CAST(page AS VARCHAR) AS message "
          "FROM bitems WHERE page % 4 = 0")
def src_page_errors(spark, sf_dir):
    path = landed_once(spark, sf_dir, "board-error-pages", lambda: land_board_pages(
        fixture(spark, sf_dir, "leads"), scratch_path(spark, "board-error-pages"), error_every=4))
    return S.page_errors(S.read_board_page_frame(spark, path))


_SQL_GROUPS = ("groups AS (SELECT DISTINCT " + _sql_group_case() + " AS id FROM leads WHERE stage <> 'noshow' "
               "UNION ALL SELECT 'archive_group' AS id)")


@register("src_board_groups", sql_with(("leads",), _SQL_GROUPS) + "SELECT id, upper(id) AS title FROM groups")
def src_board_groups(spark, sf_dir):
    path = landed_once(spark, sf_dir, "board-groups", lambda: land_board_groups(
        fixture(spark, sf_dir, "leads"), scratch_path(spark, "board-groups")))
    return S.read_board_groups(spark, path)


@register("join_missing_groups", sql_with(("leads",), _SQL_GROUPS) +
          "SELECT m.group_id, m.stage FROM (VALUES " + ", ".join(f"({duck.q(g)}, {duck.q(s)})" for g, s in STAGE_BY_GROUP.items()) +
          ") m(group_id, stage) WHERE m.group_id NOT IN (SELECT id FROM groups)")
def join_missing_groups(spark, sf_dir):
    path = landed_once(spark, sf_dir, "board-groups", lambda: land_board_groups(
        fixture(spark, sf_dir, "leads"), scratch_path(spark, "board-groups")))
    return J.missing_groups(J.stage_mapping(spark, STAGE_BY_GROUP), S.read_board_groups(spark, path))


@register("join_spine", sql_with(("leads",)) +
          "SELECT k.owner, CAST(coalesce(w.won, 0) AS BIGINT) AS won FROM (SELECT DISTINCT owner FROM leads WHERE owner IS NOT NULL) k "
          "LEFT JOIN (SELECT owner, count(*) AS won FROM leads WHERE stage = 'won' AND "
          f"{duck.in_range('date_created', '1997-01-01', '1997-01-31')} GROUP BY owner) w ON k.owner = w.owner")
def join_spine(spark, sf_dir):
    leads = fixture(spark, sf_dir, "leads")
    keys = K.distinct_keys(leads, "owner")
    won = T.filter_by_date(leads.filter("stage = 'won'"), "date_created", "1997-01-01", "1997-01-31")
    agg = won.groupBy("owner").agg(F.count(F.lit(1)).alias("won"))
    return J.on_spine(keys, agg, "owner")


# --- snapshot sinks and readers (K1-K8, S12-S15) ------------------------------

RUN_TS = dt.datetime(2024, 1, 31, 6, 0, 0)
SNAP_COLS = ["item_id", "stage", "owner", "email", "deal_value", "utm_source"]


@register("sink_combined_csv", sql_with(("leads",)) +
          "SELECT item_id, stage, owner, email, NULLIF(deal_value, '') AS deal_value, NULLIF(utm_source, '') AS utm_source FROM leads")
def sink_combined_csv(spark, sf_dir):
    root = scratch_path(spark, "snapshots")
    path = W.write_combined_csv(fixture(spark, sf_dir, "leads").select(*SNAP_COLS), root, RUN_TS)
    return SN.read_snapshot_csv(spark, path).select(*SNAP_COLS)


@register("src_snapshot_csv", sql_with(("leads",)) +
          "SELECT item_id, seq, stage, NULLIF(deal_value, '') AS deal_value FROM leads")
def src_snapshot_csv(spark, sf_dir):
    root = scratch_path(spark, "snapshots")
    leads = fixture(spark, sf_dir, "leads").select("item_id", "seq", "stage", "deal_value")
    path = W.write_combined_csv(leads, root, RUN_TS)
    return SN.read_snapshot_csv(spark, path, schema=leads.schema)


@register("sink_stage_csv", sql_with(("leads",)) +
          "SELECT item_id, owner, NULLIF(deal_value, '') AS deal_value, stage FROM leads")
def sink_stage_csv(spark, sf_dir):
    root = scratch_path(spark, "snapshots")
    leads = fixture(spark, sf_dir, "leads").select("item_id", "stage", "owner", "deal_value")
    W.write_stage_csvs(leads.filter("stage = 'lost'"), root, RUN_TS)      # previous session
    path = W.write_stage_csvs(leads, root, RUN_TS + dt.timedelta(hours=4))  # replaces it
    return SN.read_snapshot_csv(spark, path, schema=leads.schema).select("item_id", "owner", "deal_value", "stage")


GROUPED = "item_id string, owner string, note string, stage string"


@register("sink_grouped_json", sql_with(("leads",)) + "SELECT item_id, owner, stage FROM leads")
def sink_grouped_json(spark, sf_dir):
    root = scratch_path(spark, "snapshots")
    path = W.write_grouped_json(fixture(spark, sf_dir, "leads").select("item_id", "owner", "stage"), root, RUN_TS)
    return SN.read_grouped_json(spark, path, GROUPED).select("item_id", "owner", "stage")


@register("src_grouped_json", sql_with(("leads",)) +
          "SELECT stage, item_id, owner, CAST(NULL AS VARCHAR) AS note FROM leads")
def src_grouped_json(spark, sf_dir):
    root = scratch_path(spark, "snapshots")
    path = W.write_grouped_json(fixture(spark, sf_dir, "leads").select("item_id", "owner", F.lit(None).cast("string").alias("note"), "stage"), root, RUN_TS)
    return SN.read_grouped_json(spark, path, GROUPED).select("stage", "item_id", "owner", "note")


CHUNK = 1000
SQL_CHUNKS = f"chunks AS (SELECT uri, (row_number() OVER (ORDER BY uri) - 1) // {CHUNK} + 1 AS chunk_number FROM invitees)"


@register("sink_chunked_json", sql_with(("invitees",), SQL_CHUNKS) + "SELECT uri, CAST(chunk_number AS INTEGER) AS chunk_number FROM chunks")
def sink_chunked_json(spark, sf_dir):
    return _chunks(spark, sf_dir).select(F.explode("invitees.uri").alias("uri"), F.col("metadata.chunk_number").cast("int").alias("chunk_number"))


CHUNK_SCHEMA = ("invitees array<struct<uri: string, email: string>>, metadata struct<chunk_number: long, total_chunks: long, "
                "chunk_size: long, total_invitees: long, extraction_timestamp: string, base_filename: string>")


def _chunks(spark, sf_dir):
    """Written chunk documents, read again."""
    base = f"{scratch_path(spark, 'chunks')}/invitees"
    data, _ = W.write_chunked_json(fixture(spark, sf_dir, "invitees").select("uri", "email"), base, "uri", CHUNK, RUN_TS)
    return spark.read.schema(CHUNK_SCHEMA).json(data)


@register("sink_chunk_files", sql_with(("invitees",), SQL_CHUNKS) +
          "SELECT chunk_number, 1::BIGINT AS files, 1::BIGINT AS documents, CAST(count(*) AS BIGINT) AS records, CAST(count(*) AS BIGINT) AS chunk_size, "
          "(SELECT CAST(count(*) AS BIGINT) FROM chunks) AS total_invitees, min(uri) AS first_uri, max(uri) AS last_uri, "
          f"{duck.q(RUN_TS.isoformat())} AS extraction_timestamp, 'invitees' AS base_filename FROM chunks GROUP BY chunk_number")
def sink_chunk_files(spark, sf_dir):
    """Each chunk is one document in one file of its own, in order, with its metadata."""
    docs = _chunks(spark, sf_dir).withColumn("file", F.input_file_name())
    alone = docs.groupBy("file").agg(F.count(F.lit(1)).alias("documents"))
    m = F.col("metadata")
    return (docs.join(alone, "file").groupBy(m["chunk_number"].alias("chunk_number"))
            .agg(F.count_distinct("file").alias("files"), F.max("documents").alias("documents"), F.sum(F.size("invitees")).alias("records"),
                 *[F.max(m[c]).alias(c) for c in ("chunk_size", "total_invitees")], F.min(F.element_at("invitees", 1)["uri"]).alias("first_uri"),
                 F.max(F.element_at("invitees", -1)["uri"]).alias("last_uri"), *[F.max(m[c]).alias(c) for c in ("extraction_timestamp", "base_filename")]))


@register("sink_chunk_manifest", sql_with(("invitees",), SQL_CHUNKS) +
          "SELECT chunk_number, CAST(count(*) AS BIGINT) AS chunk_size, max(chunk_number) OVER () AS total_chunks FROM chunks GROUP BY chunk_number")
def sink_chunk_manifest(spark, sf_dir):
    base = scratch_path(spark, "chunks")
    _, manifest = W.write_chunked_json(fixture(spark, sf_dir, "invitees").select("uri", "email"), base, "uri", CHUNK)
    return spark.read.schema("chunk_number long, chunk_size long, total_chunks long").json(manifest)


_INV_EXPORT = ("SELECT uri, event_uri, email, status, pos FROM invitees")


@register("sink_export_csv", sql_with(("invitees",)) +
          "SELECT uri, event_uri, NULLIF(email, '') AS email, status, pos FROM invitees")
def sink_export_csv(spark, sf_dir):
    df = fixture(spark, sf_dir, "invitees").select("uri", "event_uri", "email", "status", "pos")
    out = W.export_formats(df, scratch_path(spark, "export"), ("csv",))
    return spark.read.option("header", True).option("nullValue", "").schema(df.schema).csv(out["csv"])


@register("sink_export_parquet", sql_with(("invitees",)) + _INV_EXPORT)
def sink_export_parquet(spark, sf_dir):
    df = fixture(spark, sf_dir, "invitees").select("uri", "event_uri", "email", "status", "pos")
    out = W.export_formats(df, scratch_path(spark, "export"), ("parquet",))
    return spark.read.parquet(out["parquet"])


def _entity_back(spark, kind, df):
    """Export all columns of an entity, and read them back as text."""
    path = W.export_entity_csv(kind, df, scratch_path(spark, "entities"))
    back = spark.read.schema(", ".join(f"{c} string" for c in df.columns)).option("header", True).csv(path)
    if back.columns != df.columns:
        raise AssertionError(f"{kind}: columns {back.columns}")
    return back


@register("sink_entity_csv_invitees", sql_with(("invitees",)) +
          "SELECT uri, event_uri, CAST(pos AS VARCHAR) AS pos, status, email, name, timezone, utm_source, utm_medium, utm_campaign, created_at FROM invitees")
def sink_entity_csv_invitees(spark, sf_dir):
    inv = fixture(spark, sf_dir, "invitees").withColumn(
        "tracking", F.struct("utm_source", "utm_medium", "utm_campaign")).drop("utm_source", "utm_medium", "utm_campaign")
    tr = F.from_json("tracking", "utm_source string, utm_medium string, utm_campaign string")
    return _entity_back(spark, "invitees", inv).select(*[c for c in inv.columns if c not in ("tracking", "created_at")],
                                                       F.col("created_at").cast(inv.schema["created_at"].dataType).alias("created_at"), tr["utm_source"].alias("utm_source"),
                                                       tr["utm_medium"].alias("utm_medium"), tr["utm_campaign"].alias("utm_campaign"))


@register("sink_entity_csv_events", sql_with(("event_types",)) +
          "SELECT uri, name, CAST(active AS VARCHAR) AS active, type, kind, duration, owner_type, owner_uri, created_at, updated_at FROM event_types")
def sink_entity_csv_events(spark, sf_dir):
    return _entity_back(spark, "events", fixture(spark, sf_dir, "event_types"))


@register("sink_entity_csv_members", sql_with(("members",)) + "SELECT user_uri, name, email, role, status, organization FROM members")
def sink_entity_csv_members(spark, sf_dir):
    return _entity_back(spark, "members", fixture(spark, sf_dir, "members"))


MEMBER_SCHEMA = "user_uri string, name string, email string, role string, status string, organization string"


@register("sink_members_json", sql_with(("members",)) +
          "SELECT user_uri, name, email, role, status, organization, '2024-01-31T06:00:00' AS extraction_timestamp, "
          "'organizations/1' AS organization_uri, (SELECT CAST(count(*) AS BIGINT) FROM members) AS total_members FROM members")
def sink_members_json(spark, sf_dir):
    """Member rows beside the metadata document, both read back."""
    data, meta = W.export_members_json(fixture(spark, sf_dir, "members"), scratch_path(spark, "members-json"),
                                       RUN_TS, "organizations/1")
    about = spark.read.schema("metadata struct<extraction_timestamp:string,organization_uri:string,total_members:long>").json(meta).first().metadata
    return spark.read.schema(MEMBER_SCHEMA).json(data).select(
        "*", *[F.lit(about[c]).alias(c) for c in ("extraction_timestamp", "organization_uri", "total_members")])


@register("sink_profile_json", sql_with(("members",)) +
          "SELECT '2024-01-31T06:00:00' AS extraction_timestamp, user_uri AS uri, name, email FROM members")
def sink_profile_json(spark, sf_dir):
    prof = fixture(spark, sf_dir, "members").select(F.col("user_uri").alias("uri"), "name", "email")
    path = W.export_profile_json(prof, scratch_path(spark, "profile-json"), RUN_TS)
    back = spark.read.schema("metadata struct<extraction_timestamp:string>, user struct<uri:string,name:string,email:string>").json(path)
    return back.select("metadata.extraction_timestamp", "user.*")


@register("sink_manifest", sql_with(("bookings", "invitees", "members")) +
          "SELECT '2024-01-31T06:00:00' AS timestamp, true AS success, "
          "(SELECT CAST(count(*) AS BIGINT) FROM bookings) AS events, "
          "(SELECT CAST(count(*) AS BIGINT) FROM invitees) AS invitees, "
          "(SELECT CAST(count(*) AS BIGINT) FROM members) AS members, CAST(0 AS BIGINT) AS nothing")
def sink_manifest(spark, sf_dir):
    parts = {"events": fixture(spark, sf_dir, "bookings"), "invitees": fixture(spark, sf_dir, "invitees"),
             "members": fixture(spark, sf_dir, "members"), "nothing": fixture(spark, sf_dir, "members").filter("false")}
    path, _ = W.extraction_manifest(parts, RUN_TS, scratch_path(spark, "manifest"))
    doc = spark.read.schema("timestamp string, success boolean, summary map<string,long>").json(path)
    return doc.select("timestamp", "success", *[F.col(f"summary.{p}").alias(p) for p in parts])


def _two_runs(spark, sf_dir):
    root = scratch_path(spark, "snapshots")
    leads = fixture(spark, sf_dir, "leads").select("item_id", "stage", "owner")
    W.write_combined_csv(leads.filter("stage = 'won'"), root, RUN_TS)
    W.write_combined_csv(leads, root, RUN_TS + dt.timedelta(hours=4))
    W.write_grouped_json(leads, root, RUN_TS)
    return root


_RUN2 = "TIMESTAMP '2024-01-31 10:00:00'"
_ALL_LEADS = "(SELECT CAST(count(*) AS BIGINT) FROM leads)"


def _run_contents(spark, path, family):
    """One row: the rows, files and bytes of a run as its reader and the listing find them."""
    rows = spark.read.json(path) if family == "grouped" else SN.read_snapshot_csv(spark, path)
    listing = SN.file_listing(spark, path).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
    both = rows.agg(F.count(F.lit(1)).alias("rows")).unionByName(listing, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("rows", "n_files", "n_bytes")])


@register("src_latest_snapshot", sql_with(("leads",)) +
          f"SELECT 'combined' AS family, 'run=20240131_100000' AS file_name, {_RUN2} AS run_timestamp, {_ALL_LEADS} AS rows, true AS whole "
          f"UNION ALL SELECT 'grouped', 'run=20240131_060000', TIMESTAMP '2024-01-31 06:00:00', {_ALL_LEADS}, true")
def src_latest_snapshot(spark, sf_dir):
    """The newest run of each family, the rows read from it, and whether its size and number of files are
    those of its folder."""
    root = _two_runs(spark, sf_dir)
    latest = SN.latest_snapshot(spark, f"{root}/*/run=*")
    out = None
    for r in latest.select("family", "path").collect():           # two families
        found = F.broadcast(_run_contents(spark, r.path, r.family).withColumn("family", F.lit(r.family)))
        part = latest.join(found, "family").select("family", "file_name", "run_timestamp", "rows",
                                                   ((F.col("length") == F.col("n_bytes")) & (F.col("files") == F.col("n_files"))).alias("whole"))
        out = part if out is None else out.unionByName(part)
    return out


@register("src_snapshot_status", sql_with(("leads",)) +
          f"SELECT 'combined' AS family, true AS exists, 'run=20240131_100000' AS file_name, {_ALL_LEADS} AS rows, true AS size_found "
          f"UNION ALL SELECT 'grouped', true, 'run=20240131_060000', {_ALL_LEADS}, true UNION ALL SELECT 'invitees', false, NULL, 0, false")
def src_snapshot_status(spark, sf_dir):
    root = _two_runs(spark, sf_dir)
    st = SN.snapshot_status(spark, f"{root}/*/run=*", ["combined", "grouped", "invitees"])
    paths = SN.latest_snapshot(spark, f"{root}/*/run=*").select("family", "path").collect()
    found = None
    for r in paths:
        part = _run_contents(spark, r.path, r.family).withColumn("family", F.lit(r.family))
        found = part if found is None else found.unionByName(part)
    return (st.join(F.broadcast(found), "family", "left")
            .select("family", "exists", "file_name", F.coalesce("rows", F.lit(0)).alias("rows"),
                    F.coalesce(F.col("size_kb") == F.round(F.col("n_bytes") / 1024.0, 2), F.lit(False)).alias("size_found")))


# --- end-to-end refresh (S1 + P1-P3 + S3/S6/S7 + J3 + J1 + K1-K3) -------------

def _land_invitees(spark, sf_dir):
    inv = fixture(spark, sf_dir, "invitees")
    row = F.struct("uri", "email", "name", "status", "timezone")
    path = scratch_path(spark, "invitee-pages")
    return land_collection(inv, path, F.col("event_uri"), F.lit(1), F.col("pos"), row)


def _land_events(spark, sf_dir):
    b = fixture(spark, sf_dir, "bookings").withColumn("_id", F.substring_index("uri", "/", -1).cast("long"))
    row = F.struct("uri", "name", "status", F.date_format("start_time", ISO_SPARK).alias("start_time"), "event_type")
    path = scratch_path(spark, "event-pages")
    return land_collection(b, path, F.col("status"), F.floor(F.col("_id") / 100) + 1, F.col("_id"), row)


@register("flow_full_refresh", sql_leads_origin_with() +
          "SELECT item_id, stage, owner, email, deal_value, origin FROM leads_origin")
def flow_full_refresh(spark, sf_dir):
    from leadflow.plans import refresh as R
    from leadflow.plans.fixtures import FIXTURE_TYPE_ORIGINS
    board = _board_pages(spark, sf_dir)
    out = R.refresh(spark, board, _land_events(spark, sf_dir), _land_invitees(spark, sf_dir),
                    FIXTURE_TYPE_ORIGINS, out_root=scratch_path(spark, "refresh"), run_ts=RUN_TS)
    return out.select("item_id", "stage", "owner", "email", "deal_value", "origin")


# --- published sessions and the one-document form ---------------------------------

SESSION_COLS = ["item_id", "stage", "owner", "email", "deal_value"]


@register("sink_session", sql_with(("leads",)) +
          "SELECT 'combined' AS dataset, item_id, stage, owner, email, nullif(deal_value, '') AS deal_value FROM leads "
          "UNION ALL SELECT 'stages', item_id, stage, owner, email, nullif(deal_value, '') FROM leads")
def sink_session(spark, sf_dir):
    """Two refreshes published one after the other; readers get the newer one, whole."""
    root, leads = scratch_path(spark, "published"), fixture(spark, sf_dir, "leads").select(*SESSION_COLS)
    SS.publish_session(leads.filter("stage = 'won'"), root, RUN_TS)
    SS.publish_session(leads, root, RUN_TS + dt.timedelta(hours=4))
    ddl = ", ".join(f"{c} string" for c in SESSION_COLS)
    return (SS.read_session_csv(spark, root, "combined", ddl).select(F.lit("combined").alias("dataset"), *SESSION_COLS)
            .unionByName(SS.read_session_csv(spark, root, "stages", ddl).select(F.lit("stages").alias("dataset"), *SESSION_COLS)))


@register("src_grouped_document", sql_with(("leads",)) + "SELECT stage, item_id, seq, owner, deal_value FROM leads")
def src_grouped_document(spark, sf_dir):
    """All leads as one ``{stage: [records]}`` document, written in ordered parts and read back by splits."""
    leads = fixture(spark, sf_dir, "leads").select("stage", "item_id", F.col("seq").cast("long").alias("seq"), "owner", "deal_value")
    path = SS.write_document(leads, scratch_path(spark, "document"), ["seq"])
    return DOC.read_document(spark, path, leads.drop("stage").schema)


@register("set_union_landed_stages", sql_with(("leads",)) + "SELECT item_id, owner, email, nullif(deal_value, '') AS deal_value, stage FROM leads")
def set_union_landed_stages(spark, sf_dir):
    """The union of the stages' own snapshots, each read from its folder of the published session."""
    root, leads = scratch_path(spark, "published"), fixture(spark, sf_dir, "leads").select(*SESSION_COLS)
    SS.publish_session(leads, root, RUN_TS)
    path = SS.session_path(spark, root, "stages")
    ddl = "item_id string, owner string, email string, deal_value string"
    return T.union_stages([SN.read_snapshot_csv(spark, f"{path}/stage={stage}", schema=ddl).withColumn("stage", F.lit(stage))
                           for stage in STAGE_BY_GROUP.values()])

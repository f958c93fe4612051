"""Readers for landed API pages (JSON) -> typed DataFrames.

Landing contract: every page document is one JSON object (JSON lines; set
``multi_line=True`` for one pretty-printed document per file) holding the
API's body plus two landing fields, ``stream`` (what was asked for: a
status, an event uri, a board group) and ``page`` (1-based request order).
Raw API bodies without those fields work too when landed as
``<stream>/page-<n>.json``: the stream comes from the folder name and the
page from the number in the file name. Files are read with an explicit
schema, so there is no inference pass, and only the referenced fields are
materialized.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.functions.columns import uri_tail
from leadflow.session import scratch_path
from leadflow.schemas import (BOARD_ITEM, BOARD_PAGE, EVENT_TYPE_ROW, INVITEE_ROW,
                              MEMBERSHIP_ROW, PROFILE_FIELDS, PROFILE_PAGE,
                              SCHEDULED_EVENT_ROW, collection_page)

LANDING_FIELDS = [T.StructField("stream", T.StringType()), T.StructField("page", T.LongType())]


def _with_landing(schema: T.StructType) -> T.StructType:
    return T.StructType(LANDING_FIELDS + list(schema.fields))


PAGE_NUMBER_RE = r"(\d+)\.json[^/]*$"


def read_pages(spark: SparkSession, path: str, schema: T.StructType,
               multi_line: bool = False) -> DataFrame:
    """Page documents with ``stream``/``page`` (from the document, else from
    the file path)."""
    df = spark.read.schema(_with_landing(schema)).option("multiLine", multi_line).json(path)
    fp = F.col("_metadata.file_path")
    folder = F.element_at(F.split(fp, "/"), -2)
    num = F.nullif(F.regexp_extract(fp, PAGE_NUMBER_RE, 1), F.lit("")).cast("long")
    return df.select(F.coalesce(F.col("stream"), folder).alias("stream"),
                     F.coalesce(F.col("page"), num).alias("page"),
                     *[F.col(f.name) for f in schema.fields])


#: At most this many failed streams are broadcast.
MAX_BROADCAST_STREAMS = 100_000


# --- S3 / S4: generic collection pages ------------------------------------

def read_collection_pages(spark: SparkSession, path: str, row_schema: T.StructType,
                          multi_line: bool = False) -> DataFrame:
    """Page-level frame: stream, page, error, next_page, collection."""
    p = read_pages(spark, path, collection_page(row_schema), multi_line)
    return p.select("stream", "page", "error", F.col("pagination.next_page").alias("next_page"),
                    "collection")


def prefix_until_error(pages: DataFrame, stream: str = "stream", page: str = "page",
                       error: str = "error") -> DataFrame:
    """Keep, per stream, the pages before its first failed page.
    :func:`pages_cut` gives the others.

    The first failed page per stream is one partial aggregate over the failed
    pages alone, joined back without moving a stream's pages into one task.
    """
    out = _with_first_error(pages, stream, page, error)
    return out.filter(F.col("_first_err").isNull() | (F.col(page) < F.col("_first_err"))).drop("_first_err")


def pages_cut(pages: DataFrame, stream: str = "stream", page: str = "page", error: str = "error") -> DataFrame:
    """The pages :func:`prefix_until_error` leaves out: each stream's first failed
    page and all after it."""
    out = _with_first_error(pages, stream, page, error)
    return out.filter(F.col(page) >= F.col("_first_err")).drop("_first_err")


def _with_first_error(pages: DataFrame, stream: str, page: str, error: str) -> DataFrame:
    cut = (pages.filter(F.col(error).isNotNull()).groupBy(F.col(stream).alias("_stream"))
                .agg(F.min(page).alias("_first_err")))
    # One row per failed stream; beyond the checked size the join is left to Catalyst.
    few = cut.limit(MAX_BROADCAST_STREAMS + 1).count() <= MAX_BROADCAST_STREAMS
    return pages.join(F.broadcast(cut) if few else cut, pages[stream] == F.col("_stream"), "left").drop("_stream")


def pages_to_rows(pages: DataFrame, keep=("stream", "page")) -> DataFrame:
    """One row per collection element, with its 1-based position ``pos``."""
    x = pages.select(*keep, F.posexplode("collection").alias("_p", "_row"))
    return x.select(*keep, (F.col("_p") + 1).alias("pos"), "_row.*")


def read_collection_rows(spark: SparkSession, path: str, row_schema: T.StructType,
                         stop_at_error: bool = True, multi_line: bool = False) -> DataFrame:
    """Landed pages -> rows, pages after a stream's first error dropped."""
    pages = read_collection_pages(spark, path, row_schema, multi_line)
    if stop_at_error:
        pages = prefix_until_error(pages)
    return pages_to_rows(pages)


# --- S1 / S2 / S5: board pages -----------------------------------------------

def read_board_page_frame(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_pages(spark, path, BOARD_PAGE, multi_line)


def page_errors(pages: DataFrame) -> DataFrame:
    """Pages that carry ``errors``, with their messages joined by newline."""
    return (pages.filter(F.size(F.coalesce(F.col("errors"), F.array())) > 0)
                 .select("stream", "page",
                         F.array_join(F.transform("errors", lambda e: e["message"]), "\n").alias("message")))


def assert_no_page_errors(pages: DataFrame, report: str | None = None) -> DataFrame:
    """Eager check: raise if any page carries errors; returns ``pages``.

    Every error row is written to the dataset ``report`` (default: a new folder
    in the shared scratch folder); the exception names it, the number of pages and
    the first page's message.
    """
    path = report or scratch_path(pages.sparkSession, "page-errors")
    bad = page_errors(pages)
    bad.write.mode("overwrite").json(path)
    written = pages.sparkSession.read.schema(bad.schema).json(path)
    n = written.count()
    if n:
        first = written.orderBy("stream", "page").first()["message"]
        raise RuntimeError(f"{n} board pages returned errors (all in {path}):\n{first}")
    return pages


def fail_on_page_errors(pages: DataFrame) -> DataFrame:
    """Lazy check in the same scan: the job fails on the first page that
    carries errors, with that page's messages joined by newline."""
    errs = F.coalesce(F.col("errors"), F.array())
    msg = F.concat(F.lit("board pages returned errors:\n"),
                   F.array_join(F.transform(errs, lambda e: e["message"]), "\n"))
    check = F.when(F.size(errs) > 0, F.raise_error(msg))
    return pages.filter(F.coalesce(check.cast("boolean"), F.lit(True)))


def read_board_items(spark: SparkSession, path: str, check_errors: bool = True,
                     multi_line: bool = False) -> DataFrame:
    """Cursor-paged board items, first-page and next-page shapes alike.

    Output: group_id (= stream), page, pos, id, name, column_values.
    """
    pages = read_board_page_frame(spark, path, multi_line)
    if check_errors:
        pages = fail_on_page_errors(pages)
    first = F.get(F.get(F.col("data.boards"), 0)["groups"], 0)["items_page"]["items"]
    items = F.coalesce(first, F.col("data.next_items_page.items"))
    x = pages.select(F.col("stream").alias("group_id"), "page", F.posexplode(items).alias("_p", "_it"))
    return x.select("group_id", "page", (F.col("_p") + 1).alias("pos"), "_it.*")


def read_board_groups(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Board groups ``(id, title)``; errors, no boards or no groups fail."""
    pages = fail_on_page_errors(read_board_page_frame(spark, path, multi_line))
    groups = pages.select(F.explode(F.get(F.col("data.boards"), 0)["groups"]).alias("g"))
    out = groups.select(F.col("g.id").alias("id"), F.col("g.title").alias("title"))
    if not out.take(1):
        raise RuntimeError("board has no groups")
    return out


# --- S6 .. S11: typed calendar rows -----------------------------------------

def _s(c: str, default: str | None = "") -> Column:
    col = F.col(c)
    return F.coalesce(col, F.lit(default)).alias(c) if default is not None else col.alias(c)


def scheduled_events(rows: DataFrame) -> DataFrame:
    """Typed bookings; missing/null text fields default to ''."""
    return rows.select(
        *[_s(c) for c in ("uri", "name", "status", "start_time", "end_time", "event_type")],
        F.coalesce("location", F.create_map().cast("map<string,string>")).alias("location"),
        F.coalesce("invitees_counter", F.create_map().cast("map<string,string>")).alias("invitees_counter"),
        _s("created_at"), _s("updated_at"),
        F.coalesce("event_memberships", F.array().cast(SCHEDULED_EVENT_ROW["event_memberships"].dataType))
         .alias("event_memberships"),
        F.coalesce("event_guests", F.array().cast(SCHEDULED_EVENT_ROW["event_guests"].dataType))
         .alias("event_guests"))


def invitees(rows: DataFrame, events: DataFrame | None = None,
             event_uri_col: str = "stream") -> DataFrame:
    """Typed invitees carrying the parent event uri (the page stream), their
    page position (``page``, ``pos``) and, when ``events`` is given, the
    event name; event type fields are constants."""
    position = [c for c in ("page", "pos") if c in rows.columns]
    out = rows.select(
        F.col(event_uri_col).alias("event_uri"), *position,
        *[_s(c) for c in ("uri", "email", "name", "status")],
        F.coalesce("questions_and_answers", F.array().cast(INVITEE_ROW["questions_and_answers"].dataType))
         .alias("questions_and_answers"),
        _s("timezone"), _s("text_reminder_number", None), _s("created_at"), _s("updated_at"),
        F.lit("").alias("event_type_uri"), F.lit("Unknown").alias("event_type_name"),
        F.coalesce("scheduled_event", F.lit("")).alias("scheduled_event_uri"),
        _s("scheduling_url"), _s("cancel_url"), _s("reschedule_url"), F.col("tracking"))
    if events is not None:
        ev = events.select(F.col("uri").alias("event_uri"), F.col("name").alias("event_name"))
        out = out.join(ev, "event_uri", "left")
    return out


def _event_type_common(rows: DataFrame) -> list:
    cols = set(rows.columns)

    def opt(c, default=""):
        if c not in cols:
            return F.lit(default).alias(c)
        return _s(c, default)
    return [opt("uri"), opt("name"),
            (F.coalesce(F.col("active"), F.lit(False)) if "active" in cols else F.lit(False)).alias("active"),
            opt("type"), opt("kind"), opt("slug"),
            (F.coalesce(F.col("duration").cast("string"), F.lit("0")) if "duration" in cols else F.lit("0")).alias("duration"),
            opt("description_plain", None), opt("scheduling_url"), opt("color", None),
            opt("internal_note", None), opt("created_at"), opt("updated_at")]


def _organization_strategy(rows: DataFrame, org_uri: str | None = None, **_) -> DataFrame:
    owner = F.lit(org_uri) if org_uri is not None else (
        F.col("owner_uri") if "owner_uri" in rows.columns else F.col("profile.owner"))
    return rows.select(*_event_type_common(rows), F.coalesce(owner, F.lit("")).alias("owner_uri"),
                       F.lit("organization").alias("source"),
                       F.lit(None).cast("string").alias("owner_name"),
                       F.lit(None).cast("string").alias("owner_email"))


def _user_strategy(rows: DataFrame, members: DataFrame | None = None, **_) -> DataFrame:
    owner = F.col("owner_uri") if "owner_uri" in rows.columns else F.col("stream")
    out = rows.select(*_event_type_common(rows), owner.alias("owner_uri"), F.lit("user").alias("source"))
    if members is None:
        return out.withColumn("owner_name", F.lit(None).cast("string")).withColumn(
            "owner_email", F.lit(None).cast("string"))
    m = members.select(F.col("user_uri").alias("owner_uri"), F.col("name").alias("owner_name"),
                       F.col("email").alias("owner_email"))
    return out.join(m, "owner_uri", "left")


# Extraction strategies: name -> DataFrame function; users may add more.
EVENT_TYPE_STRATEGIES = {"organization": _organization_strategy, "user": _user_strategy}


def extract_event_types(rows: DataFrame, strategy: str, **kw) -> DataFrame:
    """Typed event types by owner strategy (``organization`` or ``user``)."""
    return EVENT_TYPE_STRATEGIES[strategy](rows, **kw)


def members(rows: DataFrame) -> DataFrame:
    """Memberships flattened from the nested ``user`` struct."""
    return rows.select(F.col("user.uri").alias("user_uri"), F.col("user.name").alias("name"),
                       F.col("user.email").alias("email"), "role", "status", "organization",
                       F.col("uri").alias("membership_uri"))


def read_user_profile(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    p = spark.read.schema(PROFILE_PAGE).option("multiLine", multi_line).json(path)
    return user_profile(p)


def user_profile(pages: DataFrame) -> DataFrame:
    """Nine profile fields from ``resource``."""
    return pages.select(*[F.col(f"resource.{f}").alias(f) for f in PROFILE_FIELDS])


def organization_info(profile: DataFrame) -> DataFrame:
    """Organization uri and id (last path segment)."""
    return profile.select(F.col("current_organization").alias("organization_uri"),
                          uri_tail("current_organization").alias("organization_id"))


ROW_SCHEMAS = {
    "scheduled_events": SCHEDULED_EVENT_ROW,
    "invitees": INVITEE_ROW,
    "event_types": EVENT_TYPE_ROW,
    "memberships": MEMBERSHIP_ROW,
    "board_items": BOARD_ITEM,
}

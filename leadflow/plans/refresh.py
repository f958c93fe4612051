"""End-to-end refresh: landed pages -> leads with origin -> snapshots.

``read board pages -> items_to_wide -> rename -> tag_stage`` builds the
lead table; ``scheduled events -> type filter -> origin tag -> first
invitee`` builds the bookings; ``annotate_origins`` joins them; the lead
table is cut from its lineage (written to the shared
checkpoint folder as Parquet) before it feeds the snapshot sinks, so each sink reads
the same rows and a lost executor never re-runs the whole ingest.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.operators import joins as J
from leadflow.operators import transform as T
from leadflow.schemas import INVITEE_ROW, LEAD_COLUMN_BY_ID, SCHEDULED_EVENT_ROW, STAGE_BY_GROUP
from leadflow.sinks.session import ROW_ID, publish_session, session_rows
from leadflow.sources import pages as S


def build_leads(spark: SparkSession, board_path: str, columns: list[str] | None = None,
                stage_map: dict = STAGE_BY_GROUP) -> DataFrame:
    """Board pages -> canonical lead rows with ``stage``."""
    items = S.read_board_items(spark, board_path)
    wide = T.items_to_wide(items, columns, keep=("group_id",))
    return T.tag_stage(T.rename_columns(wide, LEAD_COLUMN_BY_ID), stage_map).drop("group_id")


def build_bookings(spark: SparkSession, events_path: str, invitees_path: str,
                   type_origins: dict, lookback_days: int | None = None,
                   now: _dt.datetime | None = None) -> DataFrame:
    """Scheduled-event and invitee pages -> target-type bookings with origin
    and first invitee (optionally within a look-back window)."""
    ev = S.scheduled_events(S.read_collection_rows(spark, events_path, SCHEDULED_EVENT_ROW))
    if lookback_days is not None:
        ev = T.filter_lookback(ev.withColumn("_st", F.try_to_timestamp("start_time")), "_st",
                               lookback_days, now).drop("_st")
    types = [t for ts in type_origins.values() for t in ts]
    ev = T.tag_event_origin(T.filter_event_types(ev, types), type_origins)
    inv = S.invitees(S.read_collection_rows(spark, invitees_path, INVITEE_ROW))
    inv = inv.withColumn("email", F.nullif("email", F.lit("")))   # missing e-mail is no e-mail
    return J.enrich_first_invitee(ev, inv)


def refresh(spark: SparkSession, board_path: str, events_path: str, invitees_path: str,
            type_origins: dict, out_root: str | None = None, run_ts: _dt.datetime | None = None,
            require_both: bool = True) -> DataFrame:
    """Leads tagged with their origin; with ``out_root``, also published there as a session:
    combined CSV, per-stage CSVs, stage-grouped JSON and document, all or none.

    ``require_both``: like the source system, refuse to run when either side
    is empty (raises ``ValueError`` instead of exiting the process).
    """
    leads = build_leads(spark, board_path)
    bookings = build_bookings(spark, events_path, invitees_path, type_origins)
    # Whether there is a booking does not depend on its invitee: an aggregate of no column spares that join.
    if require_both and (not leads.take(1) or bookings.agg(F.max(F.lit(1))).first()[0] is None):
        raise ValueError("no leads or no bookings: refusing to refresh")
    tagged = J.annotate_origins(leads, bookings)
    if out_root is None:
        return tagged
    tagged = session_rows(tagged)
    ts = run_ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    publish_session(tagged, out_root, ts)
    return tagged.drop(ROW_ID)

"""Projections, filters and reshaping of the funnel tables."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.columns import in_date_range, to_number
from leadflow.schemas import TRACKING_FIELDS
from leadflow.session import literal_table


# --- P1 / P2 / P3: board items -------------------------------------------

def first_item_column_ids(items: DataFrame, order_cols=("page", "pos")) -> list[str]:
    """Column ids of the first item (one small ordered ``limit(1)`` action)."""
    ordered = [c for c in order_cols if c in items.columns]
    first = (items.orderBy(*ordered) if ordered else items).select(
        F.transform("column_values", lambda x: x["id"]).alias("ids")).limit(1).collect()
    return _dedup(first[0]["ids"] if first and first[0]["ids"] else [])


def _dedup(ids) -> list[str]:
    seen, out = set(), []
    for i in ids or []:
        if i not in seen:
            seen.add(i)
            out.append(i)
    return out


#: At most this many groups' column ids are broadcast.
MAX_BROADCAST_GROUPS = 1000


def group_column_ids(items: DataFrame, group_col: str = "group_id",
                     order_cols=("page", "pos")) -> DataFrame:
    """Per group, the column ids of its first item (``min_by`` aggregate,
    one row per group)."""
    order = F.struct(*[F.col(c) for c in order_cols if c in items.columns])
    ids = F.transform("column_values", lambda x: x["id"])
    return items.groupBy(group_col).agg(F.min_by(ids, order).alias("_ids"))


def items_to_wide(items: DataFrame, columns: list[str] | None = None,
                  keep: tuple = (), group_col: str = "group_id") -> DataFrame:
    """Entity-attribute-value items -> one column per column id.

    Without ``columns``, each board group takes its column set from its own
    first item (later extra ids are dropped, missing ones are null) and the
    output holds the union of those sets in first-seen order; one small
    aggregate action over the groups finds it. A group whose first item has no
    columns gives no rows. For a repeated id the last
    value wins. ``keep`` carries extra input columns (e.g. the group id).
    """
    per_group = None
    if columns is None:
        if group_col in items.columns:
            per_group = group_column_ids(items, group_col)
            firsts = per_group.orderBy(group_col).collect()
            columns = _dedup([i for r in firsts for i in (r["_ids"] or [])])
        else:
            columns = first_item_column_ids(items)
    if not columns:
        return items.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"),
                            *keep).limit(0)
    src = items
    if per_group is not None:
        few = len(firsts) <= MAX_BROADCAST_GROUPS
        src = items.join(F.broadcast(per_group) if few else per_group, group_col).filter(F.size("_ids") > 0)
    cv = F.col("column_values")

    def pick(c: str):
        same_id = F.filter(cv, lambda x: x["id"] == F.lit(c))
        v = F.try_element_at(same_id, F.lit(-1))["text"]
        if per_group is not None:
            v = F.when(F.array_contains(F.col("_ids"), F.lit(c)), v)
        return v.alias(c)
    picks = [pick(c) for c in columns]
    return src.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"),
                      *picks, *keep)


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename by mapping; unknown columns keep their names."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def tag_stage(items: DataFrame, mapping: dict, group_col: str = "group_id") -> DataFrame:
    """Group id -> stage name; unmapped groups are dropped.

    The mapping is configuration (seven rows), so it is broadcast.
    """
    spark = items.sparkSession
    m = literal_table(spark, sorted(mapping.items()), f"{group_col} string, stage string")
    return items.join(F.broadcast(m), group_col)


# --- P4 .. P9: filters -----------------------------------------------------

def filter_by_date(df: DataFrame, col: str, start, end) -> DataFrame:
    """Inclusive range on the coerced date; a missing column gives an empty
    frame with the same schema."""
    if col not in df.columns:
        return df.limit(0)
    return df.filter(in_date_range(col, start, end))


def filter_lookback(df: DataFrame, col: str, days: int, now: _dt.datetime,
                    upper: bool = False) -> DataFrame:
    """``col >= now - days`` (and ``col <= now`` when ``upper``).

    ``now`` is an argument: an operator never reads the wall clock.
    """
    ts = F.col(col).cast("timestamp")
    lo = now - _dt.timedelta(days=days)
    cond = ts >= F.lit(lo)
    if upper:
        cond = cond & (ts <= F.lit(now))
    return df.filter(cond)


def filter_event_types(df: DataFrame, types, col: str = "event_type") -> DataFrame:
    """Membership in a configured list of event types."""
    return df.filter(F.col(col).isin(list(types)))


def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


def filter_user_events(df: DataFrame, user_uri: str | None,
                       col: str = "event_memberships") -> DataFrame:
    """Bookings where ``user_uri`` is among the event's members (None: all)."""
    if user_uri is None:
        return df
    return df.filter(F.exists(col, lambda m: m["user"] == F.lit(user_uri)))


def origin_of(type_col: Column, type_origins: dict) -> Column:
    """Event type -> origin label via a ``when`` chain (null when unlisted).

    Later labels override earlier ones, as in the source's tagging loop.
    """
    expr = F.lit(None).cast("string")
    for origin, types in type_origins.items():
        expr = F.when(type_col.isin(list(types)), F.lit(origin)).otherwise(expr)
    return expr


def tag_event_origin(df: DataFrame, type_origins: dict, col: str = "event_type") -> DataFrame:
    return df.withColumn("origin", origin_of(F.col(col), type_origins))


# --- P10 .. P14 -----------------------------------------------------------

def to_utc_wall(c) -> Column:
    """ISO text -> UTC wall-clock ``timestamp_ntz``; bad text -> null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def type_event_frame(df: DataFrame) -> DataFrame:
    """created/updated -> timestamp (bad -> null), active -> boolean
    (null -> false), duration -> int (non-numbers -> 0)."""
    out = df
    for c in ("created_at", "updated_at"):
        if c in out.columns:
            out = out.withColumn(c, to_utc_wall(c))
    if "active" in out.columns:
        out = out.withColumn("active", F.coalesce(F.col("active").cast("boolean"), F.lit(False)))
    if "duration" in out.columns:
        out = out.withColumn("duration",
                             F.coalesce(to_number("duration").try_cast("int"), F.lit(0)))
    return out


def flatten_tracking(df: DataFrame, col: str = "tracking") -> DataFrame:
    """Tracking struct -> six columns, default ``''``."""
    return df.select("*", *[F.coalesce(F.col(col)[f], F.lit("")).alias(f)
                            for f in TRACKING_FIELDS]).drop(col)


def max_qa_count(df: DataFrame, col: str = "questions_and_answers") -> int:
    r = df.agg(F.max(F.size(col)).alias("n")).collect()[0]["n"]
    return int(r or 0)


def flatten_qa(df: DataFrame, n: int | None = None,
               col: str = "questions_and_answers") -> DataFrame:
    """Q&A array -> ``question_j``/``answer_j`` (j = 1..n) columns.

    ``n`` defaults to the largest array (one small aggregate action).
    """
    if n is None:
        n = max_qa_count(df, col)
    cols = []
    for j in range(1, n + 1):
        e = F.get(F.col(col), j - 1)
        cols += [e["question"].alias(f"question_{j}"), e["answer"].alias(f"answer_{j}")]
    return df.select("*", *cols).drop(col)


def explode_qa(df: DataFrame, id_cols, col: str = "questions_and_answers") -> DataFrame:
    """Long form: one row per Q&A with its 1-based ``position``."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    return (df.select(*ids, F.posexplode(col).alias("_p", "_qa"))
              .select(*ids, (F.col("_p") + 1).alias("position"),
                      F.col("_qa")["question"].alias("question"),
                      F.col("_qa")["answer"].alias("answer")))


def project_subset(df: DataFrame, cols) -> DataFrame:
    return df.select(*cols)


MEMBER_EXPORT_FIELDS = ("user_uri", "name", "email", "role", "status")
MEMBER_SUMMARY_FIELDS = ("name", "email", "role", "status")


# --- sets and ordering ----------------------------------------------------

def union_stages(frames) -> DataFrame:
    """Bag union by name; missing columns become null."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_event_types(org: DataFrame, user: DataFrame) -> DataFrame:
    """Organization and user event types with a ``source`` tag (bag)."""
    return (org.withColumn("source", F.lit("organization"))
               .unionByName(user.withColumn("source", F.lit("user")), allowMissingColumns=True))


def union_status(active: DataFrame, canceled: DataFrame) -> DataFrame:
    return active.unionByName(canceled, allowMissingColumns=True)


def sort_desc(df: DataFrame, col: str, tie: str | None = None) -> DataFrame:
    order = [F.col(col).desc()] + ([F.col(tie)] if tie else [])
    return df.orderBy(*order)


def first_items(df: DataFrame, n: int, order) -> DataFrame:
    """First ``n`` rows in an explicit order (``TakeOrderedAndProject``)."""
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return df.orderBy(*order).limit(n)


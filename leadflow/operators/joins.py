"""Relational joins of the funnel model (all equi-joins).

Join strategy is left to Catalyst and AQE: small dimension tables (stage
map, type map) are broadcast explicitly because their size is fixed by
configuration; every data-sized side is a plain join that AQE may turn into a
broadcast at run time when its measured size is under the threshold, and
whose skewed partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.session import literal_table
from leadflow.schemas import ORIGIN_COLD_EMAIL, ORIGIN_LINKEDIN, ORIGIN_PRECEDENCE


def _spread_null_key(df: DataFrame, c: str):
    """Join key where a null becomes a never-matching text made from the row's
    values, so rows without a key spread over all partitions instead of hashing
    to one, and a retried task gives the same keys."""
    row = F.to_json(F.struct(*[F.col(x) for x in df.columns]))
    return F.coalesce(F.col(c), F.concat(F.lit("\u0000no-key:"), F.xxhash64(row).cast("string")))


def annotate_origins(leads: DataFrame, bookings: DataFrame,
                     lead_email: str = "email",
                     booking_email: str = "invitee_email",
                     default: str = ORIGIN_LINKEDIN) -> DataFrame:
    """Tag each lead with its acquisition origin.

    A lead whose e-mail (exact, case-sensitive) was booked under a
    cold-email event type is ``cold-email``; else under a cold-calling type
    ``cold-calling``; else ``default``. Null e-mails never match.

    Bookings collapse to one row per e-mail (max precedence) before the join,
    so the join is many-to-one and never multiplies leads. Leads without an
    e-mail get a never-matching key made from their values, so a large null group does not
    land in one partition; a hot real e-mail is split by AQE's skew join
    (the bookings side holds one row for it).
    """
    rank = F.lit(None).cast("int")
    label = F.lit(None).cast("string")
    for origin, p in ORIGIN_PRECEDENCE.items():
        rank = F.when(F.col("origin") == F.lit(origin), F.lit(p)).otherwise(rank)
        label = F.when(F.col("_prec") == F.lit(p), F.lit(origin)).otherwise(label)
    best = (bookings.select(F.col(booking_email).alias("_email"), rank.alias("_rank"))
                    .filter(F.col("_email").isNotNull() & F.col("_rank").isNotNull())
                    .groupBy("_email")
                    .agg(F.max("_rank").alias("_prec"))
                    .select("_email", label.alias("_label")))
    keyed = leads.withColumn("_jk", _spread_null_key(leads, lead_email))
    out = keyed.join(best, keyed["_jk"] == best["_email"], "left")
    return (out.withColumn("origin", F.coalesce(F.col("_label"), F.lit(default)))
               .drop("_email", "_label", "_jk"))


def annotate_origins_binary(leads: DataFrame, bookings: DataFrame,
                            lead_email: str = "email",
                            booking_email: str = "invitee_email",
                            hit: str = ORIGIN_COLD_EMAIL,
                            miss: str = ORIGIN_LINKEDIN) -> DataFrame:
    """Older two-value form: any booking e-mail -> ``hit`` else ``miss``."""
    emails = (bookings.select(F.col(booking_email).alias("_email"))
                      .filter(F.col("_email").isNotNull()).distinct()
                      .withColumn("_hit", F.lit(True)))
    keyed = leads.withColumn("_jk", _spread_null_key(leads, lead_email))
    out = keyed.join(emails, keyed["_jk"] == emails["_email"], "left")
    return (out.withColumn("origin", F.when(F.col("_hit"), F.lit(hit)).otherwise(F.lit(miss)))
               .drop("_email", "_hit", "_jk"))


STATUS_ORDER = ("active", "canceled")


def newest_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The row with the largest ``order`` (a column, or several compared in turn; nulls last) of each
    key, by one aggregate with map-side combine; rows without a key are a key of their own."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*[F.col(k) if k in keys else F.col("_r")[k].alias(k) for k in df.columns])


def first_per_key(df: DataFrame, key: str, order_cols: list) -> DataFrame:
    """Row with the smallest ``order_cols`` per ``key`` (ties: first listed).

    Implemented as ``min_by``, a partial+final aggregate (payload columns of any
    type, maps too), so a
    hot key never gathers its rows in one task (a ``row_number`` window
    would sort the whole key group inside one partition).
    """
    payload = [c for c in df.columns if c != key]
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    comparable = [F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in df.dtypes if c != key]
    packed = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                      *[c.alias(f"_p{i}") for i, c in enumerate(comparable)])
    return (df.groupBy(key).agg(F.min_by(F.struct(*payload), packed).alias("_best"))
              .select(key, *[F.col("_best")[c].alias(c) for c in payload]))


def first_invitee(invitees: DataFrame, event_key: str = "event_uri",
                  pos_cols=("page", "pos")) -> DataFrame:
    """First invitee per event: status ``active`` before ``canceled`` (other
    statuses ignored), then page position (the ``pos_cols`` present)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    pos = [c for c in pos_cols if c in invitees.columns]
    cand = (invitees.filter(rank > 0)
                    .select(event_key, rank.alias("_rank"), *pos,
                            F.col("name").alias("invitee_name"),
                            F.col("email").alias("invitee_email")))
    best = first_per_key(cand, event_key, ["_rank", *pos])
    return best.select(event_key, "invitee_name", "invitee_email")


def enrich_first_invitee(events: DataFrame, invitees: DataFrame,
                         event_uri: str = "uri") -> DataFrame:
    """Left join of events to their first invitee's name and e-mail."""
    fi = first_invitee(invitees).withColumnRenamed("event_uri", "_event_uri")
    return (events.join(fi, events[event_uri] == fi["_event_uri"], "left")
                  .drop("_event_uri"))


def event_invitees(events: DataFrame, invitees: DataFrame) -> DataFrame:
    """Inner 1:N: each invitee with its parent event's uri and name."""
    ev = events.select(F.col("uri").alias("event_uri"), F.col("name").alias("event_name"))
    return invitees.join(ev, "event_uri")


def user_event_types(members: DataFrame, types: DataFrame) -> DataFrame:
    """Each member's event types with the owner's name and e-mail."""
    m = members.select(F.col("user_uri").alias("owner_uri"),
                       F.col("name").alias("owner_name"),
                       F.col("email").alias("owner_email"))
    return types.join(m, "owner_uri")


def user_event_types_left(members: DataFrame, types: DataFrame) -> DataFrame:
    """Event types with owner name/e-mail where the owner is a member."""
    m = members.select(F.col("user_uri").alias("owner_uri"),
                       F.col("name").alias("owner_name"),
                       F.col("email").alias("owner_email"))
    return types.join(m, "owner_uri", "left")


def _type_owners(types: DataFrame) -> DataFrame:
    """Distinct owners (partial aggregation first, so an owner with a huge
    number of types costs one row per task in the shuffle)."""
    return types.select(F.col("owner_uri").alias("user_uri")).distinct()


def members_with_types(members: DataFrame, types: DataFrame) -> DataFrame:
    return members.join(_type_owners(types), "user_uri", "left_semi")


def members_without_types(members: DataFrame, types: DataFrame) -> DataFrame:
    return members.join(_type_owners(types), "user_uri", "left_anti")


def member_type_coverage(members: DataFrame, types: DataFrame) -> DataFrame:
    """One row: members, members with / without types and success rate %."""
    flagged = members.join(_type_owners(types).withColumn("_has", F.lit(True)), "user_uri", "left")
    n = F.count(F.lit(1))
    ok = F.count_if(F.col("_has").isNotNull())
    return flagged.agg(n.alias("total_members"), ok.alias("members_with_types"),
                       (n - ok).alias("members_without_types"),
                       F.round(F.coalesce(F.try_divide(ok * 100.0, n), F.lit(0.0)), 2)
                        .alias("success_rate"))


def missing_groups(mapping: DataFrame, board_groups: DataFrame,
                   key: str = "group_id") -> DataFrame:
    """Configured groups absent on the board."""
    return mapping.join(board_groups.select(F.col("id").alias(key)), key, "left_anti")


def on_spine(keys: DataFrame, agg: DataFrame, key: str, fill=0) -> DataFrame:
    """Left join of aggregates onto a key set, missing values filled."""
    value_cols = [c for c in agg.columns if c != key]
    return keys.select(key).join(agg, key, "left").fillna(fill, subset=value_cols)


def stage_mapping(spark: SparkSession, mapping: dict) -> DataFrame:
    return literal_table(spark, sorted(mapping.items()), "group_id string, stage string")

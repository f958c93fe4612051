"""Booking, event-type and lead analytics (distributions, summaries, top-k).

All results are aggregates computed with partial (map-side) aggregation;
the few global figures are one-row aggregates, and percentages over a small
grouped result use a window over that result only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.columns import month_of, weekday_of
from leadflow.session import literal_table


# --- A11 / O2 -------------------------------------------------------------

def value_counts(df: DataFrame, col: str, n: int | None = None,
                 value_name: str = "value") -> DataFrame:
    """Counts per non-null value, count desc then value asc, optional top-n."""
    out = (df.filter(F.col(col).isNotNull())
             .groupBy(F.col(col).alias(value_name))
             .agg(F.count(F.lit(1)).alias("count")))
    out = out.orderBy(F.col("count").desc(), F.col(value_name).asc())
    return out.limit(n) if n is not None else out


#: Shares of a dimension's values that are ranked apart before the final cut.
RANK_SHARES = 64


def _counts(df: DataFrame, dims) -> DataFrame:
    """``(dimension, value, count)`` of all dimensions by one ``GROUPING SETS`` aggregate."""
    cols = [c for _, c, _ in dims]
    agg = (df.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols])
             .agg(F.count(F.lit(1)).alias("count"),
                  *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(cols)]))
    dim = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, (name, c, _) in enumerate(dims):
        in_set = F.col(f"_g{i}") == 0
        dim = F.when(in_set, F.lit(name)).otherwise(dim)
        value = F.when(in_set, F.col(c).cast("string")).otherwise(value)
    return agg.select(dim.alias("dimension"), value.alias("value"), "count").filter(F.col("value").isNotNull())


def distributions(df: DataFrame, dims) -> DataFrame:
    """Several value counts of one frame.

    ``dims`` is a list of ``(dimension, column, top_n or None)`` over
    distinct columns. Uncut dimensions are one aggregate and nothing more; cut
    ones another (each reads its own columns). A cut ranks the counted values
    within hashed shares of a dimension first, so no task sorts all its
    values, then the few rows left. Null values are not counted. Output:
    ``(dimension, value, count)``.
    """
    cols = [c for _, c, _ in dims]
    if len(set(cols)) != len(cols):
        raise ValueError("one column per dimension")
    uncut, cut = [d for d in dims if d[2] is None], [d for d in dims if d[2] is not None]
    parts = [_counts(df, uncut)] if uncut else []
    if cut:
        most = max(n for *_, n in cut)
        best = (F.col("count").desc(), F.col("value").asc())
        share = F.pmod(F.xxhash64("value"), F.lit(RANK_SHARES))
        rows = (_counts(df, cut).withColumn("_share", share)
                .withColumn("_rk", F.row_number().over(Window.partitionBy("dimension", "_share").orderBy(*best)))
                .filter(F.col("_rk") <= most)
                .withColumn("_rk", F.row_number().over(Window.partitionBy("dimension").orderBy(*best)))
                .filter(F.col("_rk") <= most))
        for name, _, n in cut:
            if n < most:
                rows = rows.filter((F.col("dimension") != name) | (F.col("_rk") <= n))
        parts.append(rows.drop("_share", "_rk"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# --- A12 / A13: event types ----------------------------------------------

def event_statistics(types: DataFrame) -> DataFrame:
    """One row: totals, per-source counts, owners, duration stats, dates."""
    cols = set(types.columns)
    d = F.col("duration")
    aggs = [
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("active")).alias("active_events"),
        (F.count(F.lit(1)) - F.count_if(F.col("active"))).alias("inactive_events"),
        F.count_if(F.col("source") == "organization").alias("organization_events"),
        F.count_if(F.col("source") == "user").alias("user_events"),
        F.count_distinct(F.col("owner_name")).alias("unique_users"),
        F.min(d).alias("duration_min"), F.max(d).alias("duration_max"),
        F.round(F.avg(d), 9).alias("duration_mean"),
        F.median(d).cast("double").alias("duration_median"),
        F.round(F.stddev_samp(d), 9).alias("duration_std"),
    ]
    for c, label in (("created_at", "created"), ("updated_at", "updated")):
        if c in cols:
            aggs += [F.min(c).alias(f"earliest_{label}"), F.max(c).alias(f"latest_{label}")]
    return types.agg(*aggs)


def event_distributions(types: DataFrame) -> DataFrame:
    """kind, type and source distributions plus the top-10 owners."""
    return distributions(types, [("kind", "kind", None), ("type", "type", None),
                                 ("source", "source", None), ("top_users", "owner_name", 10)])


# --- A14 .. A16: invitees -------------------------------------------------

def invitee_summary(inv: DataFrame) -> DataFrame:
    return inv.agg(F.count(F.lit(1)).alias("total_invitees"),
                   F.count_distinct("event_uri").alias("unique_events"),
                   F.count_distinct("email").alias("unique_invitees"),
                   F.min("created_at").alias("earliest_booking"),
                   F.max("created_at").alias("latest_booking"))


def invitee_distributions(inv: DataFrame) -> DataFrame:
    """Status; event popularity (top 20); time zones (top 10)."""
    return distributions(inv, [("status", "status", None), ("event_popularity", "event_name", 20),
                               ("timezone", "timezone", 10)])


def bookings_by_month(inv: DataFrame, col: str = "created_at") -> DataFrame:
    return (value_counts(inv.select(month_of(col).alias("month")), "month", value_name="month")
            .orderBy("month"))


def bookings_by_weekday(inv: DataFrame, col: str = "created_at") -> DataFrame:
    return value_counts(inv.select(weekday_of(col).alias("weekday")), "weekday", value_name="weekday")


def invitee_utm(inv: DataFrame) -> DataFrame:
    return distributions(inv, [("sources", "utm_source", None), ("campaigns", "utm_campaign", None),
                               ("mediums", "utm_medium", None)])


def _first_positions(qa_long: DataFrame) -> DataFrame:
    """Per non-empty question: lowest position and its row count there."""
    q = qa_long.filter(F.col("question").isNotNull() & (F.col("question") != ""))
    per_pos = q.groupBy("question", "position").agg(F.count(F.lit(1)).alias("count"))
    best = per_pos.groupBy("question").agg(
        F.min(F.struct("position", "count")).alias("_b"))
    return best.select("question", F.col("_b.position").alias("first_position"),
                       F.col("_b.count").alias("count"))


def question_counts(qa_long: DataFrame) -> DataFrame:
    """``(question, first_position, count)``; the number of rows is the
    number of unique questions."""
    return _first_positions(qa_long)


def question_total(qa_long: DataFrame) -> DataFrame:
    """One row: the number of distinct non-empty questions."""
    q = qa_long.filter(F.col("question").isNotNull() & (F.col("question") != ""))
    return q.agg(F.count_distinct("question").alias("total_unique_questions"))


def question_answers(qa_long: DataFrame) -> DataFrame:
    """Answer distribution of each question, taken at its lowest position."""
    q = qa_long.filter(F.col("question").isNotNull() & (F.col("question") != ""))
    # The rows are aggregated first; the lowest position is looked for among their groups.
    per = q.groupBy("question", "position", "answer").agg(F.count(F.lit(1)).alias("count"))
    first = per.groupBy("question").agg(F.min("position").alias("position"))
    return (per.filter(F.col("answer").isNotNull()).join(first, ["question", "position"], "left_semi")
               .select("question", "answer", "count"))


# --- A17 .. A22: enrichment and extraction summaries ----------------------

def origin_breakdown(leads: DataFrame) -> DataFrame:
    """Count and percentage of leads per origin.

    The window runs over the grouped result (one row per origin label).
    """
    g = leads.groupBy("origin").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return g.withColumn("pct", F.col("count") * 100.0 / total)


def event_origin_counts(events: DataFrame, labels) -> DataFrame:
    """Events per origin label; labels without events appear with 0."""
    spark = events.sparkSession
    lab = literal_table(spark, [(x,) for x in labels], "origin string")
    counts = events.groupBy("origin").agg(F.count(F.lit(1)).alias("count"))
    return F.broadcast(lab).join(counts, "origin", "left").fillna(0, subset=["count"])


def enrichment_coverage(events: DataFrame, col: str = "invitee_email") -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("events"),
                      F.count(col).alias("enriched"),
                      F.coalesce(F.try_divide(F.count(col) * 100.0, F.count(F.lit(1))),
                                 F.lit(0.0)).alias("pct"))


def origin_emails(bookings: DataFrame, col: str = "invitee_email") -> DataFrame:
    """Distinct non-null invitee e-mails per origin."""
    return (bookings.filter(F.col("origin").isNotNull())
                    .groupBy("origin").agg(F.count_distinct(col).alias("unique_emails")))


def extraction_summary(types: DataFrame, members: DataFrame) -> DataFrame:
    """One row: organization/user/active/inactive/total type counts and
    member count, from one aggregate over the union of both inputs."""
    t = types.select(F.lit(True).alias("_t"), F.col("source"), F.col("active"))
    m = members.select(F.lit(False).alias("_t"), F.lit(None).cast("string").alias("source"),
                       F.lit(None).cast("boolean").alias("active"))
    u = t.unionByName(m)
    is_t = F.col("_t")
    return u.agg(F.count_if(is_t & (F.col("source") == "organization")).alias("total_organization_events"),
                 F.count_if(is_t & (F.col("source") == "user")).alias("total_user_events"),
                 F.count_if(~is_t).alias("total_members"),
                 F.count_if(is_t & F.coalesce(F.col("active"), F.lit(False))).alias("active_events"),
                 F.count_if(is_t & ~F.coalesce(F.col("active"), F.lit(False))).alias("inactive_events"),
                 F.count_if(is_t).alias("total_events"))


def invitee_extraction_summary(events: DataFrame, inv: DataFrame) -> DataFrame:
    """Event and invitee counts and the JSON-serialized size in MB (2 dp)."""
    e = events.select(F.lit(True).alias("_e"),
                      F.octet_length(F.to_json(F.struct(*events.columns))).alias("_b"))
    i = inv.select(F.lit(False).alias("_e"),
                   F.octet_length(F.to_json(F.struct(*inv.columns))).alias("_b"))
    u = e.unionByName(i)
    return u.agg(F.count_if(F.col("_e")).alias("total_events"),
                 F.count_if(~F.col("_e")).alias("total_invitees"),
                 F.round(F.sum("_b") / (1024.0 * 1024.0), 2).alias("data_size_mb"))


def stage_counts(leads: DataFrame) -> DataFrame:
    return leads.groupBy("stage").agg(F.count(F.lit(1)).alias("count"))

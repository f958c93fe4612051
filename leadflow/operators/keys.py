"""API-key registry and request-log jobs: key checks, rate limiting,
audit rows, usage, maintenance.

A request is checked by rules in order, the first failing rule wins:
unknown key -> revoked key -> expired key -> rate limit -> accepted.
Keys are identified by the SHA-256 of the presented text; plain keys are
never stored.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.columns import is_expired, is_valid, key_hash, key_id, truthy_or
from leadflow.operators import ratelimit as RL

# Check outcomes and audit texts.
STATUS_INVALID = "invalid"
STATUS_REVOKED = "revoked"
STATUS_EXPIRED = "expired"
STATUS_LIMITED = "rate_limited"
STATUS_OK = "ok"
STATUS_PENDING = "pending"          # passed rules 1-3, awaiting the bucket
AUDIT_ACTION = "key_validation"
AUDIT_DETAILS = {
    STATUS_INVALID: "Invalid key attempted",
    STATUS_REVOKED: "Revoked key used",
    STATUS_EXPIRED: "Expired key used",
    STATUS_LIMITED: "Rate limited: limited",
    STATUS_OK: "Key validated successfully",
}
DEFAULT_RATE_LIMIT = 100


def key_registry(keys: DataFrame, plain_col: str = "plain_key") -> DataFrame:
    """Registry rows from plain keys: hash, id (first 8 hex), attributes."""
    h = key_hash(plain_col)
    cols = [c for c in keys.columns if c != plain_col]
    out = keys.select(h.alias("key_hash"), key_id(h).alias("key_id"), *cols)
    if "rate_limit" not in out.columns:
        out = out.withColumn("rate_limit", F.lit(DEFAULT_RATE_LIMIT))
    if "description" not in out.columns:
        out = out.withColumn("description", F.lit(""))
    return out


def classify_requests(requests: DataFrame, registry: DataFrame, key_col: str = "presented_key",
                      ts_col: str = "ts", now: _dt.datetime | None = None) -> DataFrame:
    """Rules 1-3 for each request; ``status`` is ``pending`` for requests
    that reach the rate limiter. Expiry is judged at the request time unless
    ``now`` is given."""
    reg = registry.select("key_hash", "key_id", "is_active", "expires_at", "rate_limit")
    r = requests.withColumn("_h", key_hash(key_col))
    j = r.join(reg, r["_h"] == reg["key_hash"], "left").drop("_h")
    at = F.lit(now).cast("timestamp") if now is not None else F.col(ts_col).cast("timestamp")
    return j.withColumn("status", request_status(at))


def request_status(at: Column) -> Column:
    """Rules 1-3 over the columns of a joined registry row, expiry judged ``at`` a time."""
    expired = F.coalesce(at > F.col("expires_at").cast("timestamp"), F.lit(False))
    return (F.when(F.col("key_hash").isNull(), F.lit(STATUS_INVALID))
             .when(~F.coalesce(F.col("is_active"), F.lit(False)), F.lit(STATUS_REVOKED))
             .when(expired, F.lit(STATUS_EXPIRED))
             .otherwise(F.lit(STATUS_PENDING)))


def apply_rate_limit(classified: DataFrame, clock: Column, rid: str = "request_id") -> DataFrame:
    """Runs the bucket over pending requests; ``status`` becomes ``ok`` or
    ``rate_limited`` for them, other rows keep their status. The columns of a
    pending request go through the bucket with it; the rejected are added after."""
    c = classified.withColumn("clock_us", clock)
    rest = [x for x in c.columns if x not in (rid, "status")]
    decided = (RL.rate_limit(c.filter(F.col("status") == STATUS_PENDING), "key_hash", "clock_us", "rate_limit", rid, carry=rest)
               .withColumn("status", F.when(F.col("allowed"), F.lit(STATUS_OK)).otherwise(F.lit(STATUS_LIMITED))))
    rejected = (c.filter(F.col("status") != STATUS_PENDING)
                .withColumns({"allowed": F.lit(None).cast("boolean"), "tokens_after": F.lit(None).cast("double")}))
    return rejected.unionByName(decided)


def validate_requests(requests: DataFrame, registry: DataFrame, clock: Column,
                      rid: str = "request_id", **kw) -> DataFrame:
    """All four rules: classify, then the bucket."""
    return apply_rate_limit(classify_requests(requests, registry, **kw), clock, rid)


def audit_rows(checked: DataFrame, ts_col: str = "ts", ip_col: str | None = None) -> DataFrame:
    """One audit row per checked request."""
    detail = F.lit(None).cast("string")
    for st, text in AUDIT_DETAILS.items():
        detail = F.when(F.col("status") == st, F.lit(text)).otherwise(detail)
    return checked.select(
        F.col(ts_col).alias("timestamp"), F.lit(AUDIT_ACTION).alias("action"),
        F.when(F.col("status") == STATUS_INVALID, F.lit(None)).otherwise(F.col("key_id")).alias("key_id"),
        F.lit("unknown").alias("user"),
        (F.col(ip_col) if ip_col else F.lit("")).alias("ip_address"),
        (F.col("status") == STATUS_OK).alias("success"), detail.alias("details"),
        *([F.col("request_id")] if "request_id" in checked.columns else []))


def request_metrics(log: DataFrame, status_col: str = "http_status",
                    time_col: str = "response_time") -> DataFrame:
    """Attempts, successes (< 400), failures (>= 400 but 429), 429s, mean
    response time of successes and success % (2 dp, 0 when empty)."""
    st = F.col(status_col)
    ok = (st < 400) & (st != 429)
    n = F.count(F.lit(1))
    return log.agg(n.alias("total_requests"), F.count_if(ok).alias("successful_requests"),
                   F.count_if((st >= 400) & (st != 429)).alias("failed_requests"),
                   F.count_if(st == 429).alias("rate_limited_requests"),
                   F.round(F.coalesce(F.avg(F.when(ok, F.col(time_col))), F.lit(0.0)), 9)
                    .alias("average_response_time"),
                   F.round(F.coalesce(F.try_divide(F.count_if(ok) * 100.0, n), F.lit(0.0)), 2)
                    .alias("success_rate"))


def key_usage(registry: DataFrame, checked: DataFrame, ts_col: str = "ts") -> DataFrame:
    """``usage_count`` and ``last_used`` over accepted requests, per key."""
    acc = (checked.filter(F.col("status") == STATUS_OK)
                  .groupBy("key_id").agg(F.count(F.lit(1)).alias("usage_count"),
                                         F.max(ts_col).alias("last_used")))
    return (registry.select("key_id", "name").join(acc, "key_id", "left")
                    .fillna(0, subset=["usage_count"]))


def key_activity(checked: DataFrame, ts_col: str = "ts", clock: str = "clock_us", rid: str = "request_id") -> DataFrame:
    """Per key whose requests reached the bucket: ``usage_count``, ``last_used`` (of
    accepted requests) and the ``tokens`` after its last request."""
    return (checked.filter(F.col("allowed").isNotNull()).groupBy("key_hash")
                   .agg(F.count_if("allowed").alias("usage_count"),
                        F.max(F.when(F.col("allowed"), F.col(ts_col))).alias("last_used"),
                        F.max_by("tokens_after", F.struct(clock, rid)).alias("tokens")))


def key_stats(registry: DataFrame, activity: DataFrame, now) -> DataFrame:
    """Key rows with usage, ``is_valid`` at ``now`` and the whole tokens left
    (a key without a bucket reports its full limit). ``activity``: `key_activity`."""
    out = registry.join(activity, "key_hash", "left")
    return out.select("key_id", "name", "permission", "is_active", "expires_at", "rate_limit",
                      F.coalesce("usage_count", F.lit(0)).alias("usage_count"), "last_used",
                      F.floor(F.coalesce(F.col("tokens"), F.col("rate_limit").cast("double")))
                       .cast("int").alias("rate_limit_remaining"),
                      is_valid("is_active", "expires_at", now).alias("is_valid"))


def apply_key_updates(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """Patch keys: name and rate_limit only when truthy, description when
    not null (``''`` clears it)."""
    u = updates.select("key_id", F.col("name").alias("_n"), F.col("description").alias("_d"),
                       F.col("rate_limit").alias("_r"))
    j = registry.join(u, "key_id", "left")
    return (j.withColumn("name", truthy_or("_n", "name"))
             .withColumn("description", F.coalesce("_d", "description"))
             .withColumn("rate_limit", truthy_or("_r", "rate_limit", kind="number"))
             .drop("_n", "_d", "_r"))


def revoke_keys(registry: DataFrame, ids: DataFrame, id_col: str = "key_id") -> DataFrame:
    """Soft delete: listed keys become inactive."""
    hit = ids.select(F.col(id_col).alias("key_id")).distinct().withColumn("_rev", F.lit(True))
    j = registry.join(hit, "key_id", "left")
    return j.withColumn("is_active", F.col("is_active") & F.col("_rev").isNull()).drop("_rev")


def expire_keys(registry: DataFrame, now) -> DataFrame:
    """Deactivate active keys expired at ``now``; ``expired_now`` marks them
    (their count is the cleanup count)."""
    hit = F.col("is_active") & is_expired("expires_at", now)
    return (registry.withColumn("expired_now", hit)
                    .withColumn("is_active", F.col("is_active") & ~F.col("expired_now")))


def active_keys(registry: DataFrame, include_revoked: bool = False) -> DataFrame:
    """Key listing; expired but active keys are still listed."""
    return registry if include_revoked else registry.filter(F.col("is_active"))


def key_by_id(registry: DataFrame, kid: str) -> DataFrame:
    return registry.filter(F.col("key_id") == F.lit(kid))


def last_n(log: DataFrame, n: int, key: str | None = None, ts_col: str = "timestamp",
           tie: str = "request_id") -> DataFrame:
    """Last ``n`` audit entries (optionally of one key), oldest first."""
    if key is not None:
        log = log.filter(F.col("key_id") == F.lit(key))
    newest = log.orderBy(F.col(ts_col).desc(), F.col(tie).desc()).limit(n)
    return newest.orderBy(ts_col, tie)


def retained_count(n: int, cap: int = 10000, keep: int = 5000) -> int:
    """Rows an append-only log holds after ``n`` appends when every append
    that makes it exceed ``cap`` trims it to the newest ``keep``."""
    if n <= cap:
        return n
    return keep + (n - cap - 1) % (cap - keep + 1)


def retain_tail(log: DataFrame, cap: int = 10000, keep: int = 5000, ts_col: str = "timestamp",
                tie: str = "request_id", rows: int | None = None) -> DataFrame:
    """The rows the bounded audit log would still hold (a global top-k; no
    unpartitioned window). ``rows``: the log's length where it is known, as it
    is for an audit log, which has a row per request; else it is counted.
    """
    m = retained_count(log.count() if rows is None else rows, cap, keep)
    return log.orderBy(F.col(ts_col).desc(), F.col(tie).desc()).limit(m)

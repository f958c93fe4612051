"""Registered key-check, rate-limit, audit and key-maintenance queries."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from leadflow.operators import blockfold as BF
from leadflow.operators import key_versions as KV
from leadflow.operators import keys as K
from leadflow.operators import ratelimit as RL
from leadflow.plans.common import sql_with
from leadflow.plans.fixtures import CLOCK_DIVISOR, fixture
from leadflow.plans.registry import register
from leadflow.plans.landing import landed_once
from leadflow.session import scratch_path
from leadflow.streaming import requests as ST

NOW = dt.datetime(2024, 2, 15)
# State partitions of the fixture-sized stream queries (a deployment sets its own).
STREAM_PARTITIONS = 8


def registry(spark, sf_dir):
    return K.key_registry(fixture(spark, sf_dir, "api_keys"))


def clock():
    return RL.micros_clock("ts", CLOCK_DIVISOR)


def classified(spark, sf_dir):
    return K.classify_requests(fixture(spark, sf_dir, "request_log"), registry(spark, sf_dir))


def checked(spark, sf_dir):
    return K.apply_rate_limit(classified(spark, sf_dir), clock())


SQL_REGISTRY = ("registry AS (SELECT sha256(plain_key) AS key_hash, substr(sha256(plain_key), 1, 8) AS key_id, "
                "name, permission, is_active, expires_at, rate_limit, '' AS description FROM api_keys)")
SQL_CLASSIFIED = ("classified AS (SELECT r.*, g.key_hash, g.key_id, g.is_active, g.expires_at, g.rate_limit, "
                  "CASE WHEN g.key_hash IS NULL THEN 'invalid' WHEN NOT coalesce(g.is_active, false) THEN 'revoked' "
                  "WHEN coalesce(CAST(r.ts AS TIMESTAMP) > g.expires_at, false) THEN 'expired' ELSE 'pending' END AS status "
                  "FROM request_log r LEFT JOIN registry g ON sha256(r.presented_key) = g.key_hash)")
_REFILL = ("least(CAST(s.rate_limit AS DOUBLE), w.tokens + (CAST(s.clock_us - w.clock_us AS DOUBLE) / CAST(1000000 AS DOUBLE)) "
           "* (CAST(s.rate_limit AS DOUBLE) / CAST(60 AS DOUBLE)))")
SQL_BUCKET = (
    f"seq AS (SELECT request_id, key_hash, rate_limit, CAST(epoch_us(ts) AS BIGINT) // {CLOCK_DIVISOR} AS clock_us, "
    "row_number() OVER (PARTITION BY key_hash ORDER BY CAST(epoch_us(ts) AS BIGINT) // "
    f"{CLOCK_DIVISOR}, request_id) AS rn FROM classified WHERE status = 'pending'), "
    "walk AS (SELECT key_hash, rn, request_id, clock_us, rate_limit, CAST(rate_limit AS DOUBLE) - CASE WHEN rate_limit >= 1 THEN 1.0 ELSE 0.0 END AS tokens, "
    "rate_limit >= 1 AS allowed "
    "FROM seq WHERE rn = 1 UNION ALL "
    f"SELECT s.key_hash, s.rn, s.request_id, s.clock_us, s.rate_limit, CASE WHEN {_REFILL} >= 1.0 THEN {_REFILL} - 1.0 ELSE {_REFILL} END, "
    f"{_REFILL} >= 1.0 FROM walk w JOIN seq s ON s.key_hash = w.key_hash AND s.rn = w.rn + 1), "
    "checked AS (SELECT c.*, w.allowed, w.tokens AS tokens_after, CASE WHEN c.status <> 'pending' THEN c.status "
    "WHEN w.allowed THEN 'ok' ELSE 'rate_limited' END AS final_status FROM classified c LEFT JOIN walk w ON c.request_id = w.request_id)")


def _with(*ctes):
    return sql_with(("request_log", "api_keys"), SQL_REGISTRY, SQL_CLASSIFIED, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@register("join_request_status", _with() + "SELECT request_id, key_id, status FROM classified")
def join_request_status(spark, sf_dir):
    return classified(spark, sf_dir).select("request_id", "key_id", "status")


@register("batch_rate_limit", _with(SQL_BUCKET) +
          "SELECT request_id, allowed FROM checked WHERE status = 'pending'")
def batch_rate_limit(spark, sf_dir):
    c = classified(spark, sf_dir).withColumn("clock_us", clock())
    pending = c.filter(F.col("status") == K.STATUS_PENDING)
    return RL.rate_limit(pending).select("request_id", "allowed")


def _audit_sql(status: str, src: str, where: str = "") -> str:
    """Audit rows (SQL twin of ``keys.audit_rows``) from a checked table."""
    return (f"SELECT ts AS timestamp, 'key_validation' AS action, CASE WHEN {status} = 'invalid' THEN NULL ELSE key_id END AS key_id, "
            f"'unknown' AS user, '' AS ip_address, {status} = 'ok' AS success, "
            f"CASE {status} WHEN 'invalid' THEN 'Invalid key attempted' WHEN 'revoked' THEN 'Revoked key used' "
            "WHEN 'expired' THEN 'Expired key used' WHEN 'rate_limited' THEN 'Rate limited: limited' "
            f"ELSE 'Key validated successfully' END AS details, request_id FROM {src}{where}")


_AUDIT_SQL = _audit_sql("final_status", "checked")


@register("batch_audit", _with(SQL_BUCKET) + _AUDIT_SQL)
def batch_audit(spark, sf_dir):
    return K.audit_rows(checked(spark, sf_dir))


@register("agg_request_metrics", sql_with(("request_log",)) +
          "SELECT CAST(count(*) AS BIGINT) AS total_requests, "
          "CAST(count_if(http_status < 400 AND http_status <> 429) AS BIGINT) AS successful_requests, "
          "CAST(count_if(http_status >= 400 AND http_status <> 429) AS BIGINT) AS failed_requests, "
          "CAST(count_if(http_status = 429) AS BIGINT) AS rate_limited_requests, "
          "round(coalesce(avg(CASE WHEN http_status < 400 AND http_status <> 429 THEN response_time END), 0.0), 9) AS average_response_time, "
          "round(coalesce(count_if(http_status < 400 AND http_status <> 429) * 100.0 / NULLIF(count(*), 0), 0.0), 2) AS success_rate "
          "FROM request_log")
def agg_request_metrics(spark, sf_dir):
    return K.request_metrics(fixture(spark, sf_dir, "request_log"))


@register("agg_key_usage", _with(SQL_BUCKET) +
          "SELECT g.key_id, g.name, CAST(coalesce(u.n, 0) AS BIGINT) AS usage_count, u.last_used FROM registry g LEFT JOIN "
          "(SELECT key_id, count(*) AS n, max(ts) AS last_used FROM checked WHERE final_status = 'ok' GROUP BY key_id) u "
          "ON g.key_id = u.key_id")
def agg_key_usage(spark, sf_dir):
    return K.key_usage(registry(spark, sf_dir), checked(spark, sf_dir))


@register("agg_key_stats", _with(SQL_BUCKET) +
          "SELECT g.key_id, g.name, g.permission, g.is_active, g.expires_at, g.rate_limit, "
          "CAST(coalesce(u.n, 0) AS BIGINT) AS usage_count, u.last_used, "
          "CAST(floor(coalesce(b.tokens, CAST(g.rate_limit AS DOUBLE))) AS INTEGER) AS rate_limit_remaining, "
          "g.is_active AND NOT coalesce(TIMESTAMP '2024-02-15 00:00:00' > g.expires_at, false) AS is_valid "
          "FROM registry g "
          "LEFT JOIN (SELECT key_id, count(*) AS n, max(ts) AS last_used FROM checked WHERE final_status = 'ok' GROUP BY key_id) u "
          "ON g.key_id = u.key_id "
          "LEFT JOIN (SELECT key_hash, arg_max(tokens, rn) AS tokens FROM walk GROUP BY key_hash) b ON g.key_hash = b.key_hash")
def agg_key_stats(spark, sf_dir):
    return K.key_stats(registry(spark, sf_dir), K.key_activity(checked(spark, sf_dir)), NOW)


SQL_UPDATES = ("updates AS (SELECT substr(sha256(plain_key), 1, 8) AS key_id, "
               "CASE WHEN CAST(substr(plain_key, 5) AS INT) % 5 = 0 THEN 'renamed' WHEN CAST(substr(plain_key, 5) AS INT) % 5 = 1 THEN '' END AS name, "
               "CASE WHEN CAST(substr(plain_key, 5) AS INT) % 2 = 0 THEN 'desc' WHEN CAST(substr(plain_key, 5) AS INT) % 3 = 0 THEN '' END AS description, "
               "CASE WHEN CAST(substr(plain_key, 5) AS INT) % 7 = 0 THEN 0 ELSE 10 END AS rate_limit "
               "FROM api_keys WHERE CAST(substr(plain_key, 5) AS INT) % 4 <> 3)")


def updates(spark, sf_dir):
    k = fixture(spark, sf_dir, "api_keys")
    n = F.substring("plain_key", 5, 100).cast("int")
    return k.filter(n % 4 != 3).select(
        K.key_id(K.key_hash("plain_key")).alias("key_id"),
        F.when(n % 5 == 0, "renamed").when(n % 5 == 1, "").alias("name"),
        F.when(n % 2 == 0, "desc").when(n % 3 == 0, "").alias("description"),
        F.when(n % 7 == 0, 0).otherwise(10).alias("rate_limit"))


@register("join_key_patch", _with(SQL_UPDATES) +
          "SELECT g.key_id, CASE WHEN u.name IS NULL OR u.name = '' THEN g.name ELSE u.name END AS name, "
          "coalesce(u.description, g.description) AS description, "
          "CASE WHEN u.rate_limit IS NULL OR u.rate_limit = 0 THEN g.rate_limit ELSE u.rate_limit END AS rate_limit "
          "FROM registry g LEFT JOIN updates u ON g.key_id = u.key_id")
def join_key_patch(spark, sf_dir):
    return K.apply_key_updates(registry(spark, sf_dir), updates(spark, sf_dir)).select(
        "key_id", "name", "description", "rate_limit")


@register("join_key_revoke", _with() +
          "SELECT key_id, is_active AND key_id NOT IN (SELECT key_id FROM registry WHERE rate_limit = 2) AS is_active FROM registry")
def join_key_revoke(spark, sf_dir):
    reg = registry(spark, sf_dir)
    ids = reg.filter("rate_limit = 2").select("key_id")
    return K.revoke_keys(reg, ids).select("key_id", "is_active")


@register("batch_expire_keys", _with() +
          "SELECT key_id, is_active AND NOT coalesce(TIMESTAMP '2024-02-15 00:00:00' > expires_at, false) AS is_active, "
          "is_active AND coalesce(TIMESTAMP '2024-02-15 00:00:00' > expires_at, false) AS expired_now FROM registry")
def batch_expire_keys(spark, sf_dir):
    return K.expire_keys(registry(spark, sf_dir), NOW).select("key_id", "is_active", "expired_now")


@register("filt_active_keys", _with() + "SELECT key_id, name, expires_at FROM registry WHERE is_active")
def filt_active_keys(spark, sf_dir):
    return K.active_keys(registry(spark, sf_dir)).select("key_id", "name", "expires_at")


@register("filt_all_keys", _with() + "SELECT key_id, name, is_active FROM registry")
def filt_all_keys(spark, sf_dir):
    return K.active_keys(registry(spark, sf_dir), include_revoked=True).select("key_id", "name", "is_active")


KEY_SHOWN = "substr(sha256('key-3'), 1, 8)"


def _shown_key():
    return hashlib.sha256(b"key-3").hexdigest()[:8]


@register("filt_key_by_id", _with() + f"SELECT key_id, name, is_active, rate_limit FROM registry WHERE key_id = {KEY_SHOWN}")
def filt_key_by_id(spark, sf_dir):
    return K.key_by_id(registry(spark, sf_dir), _shown_key()).select("key_id", "name", "is_active", "rate_limit")


@register("win_key_last_n", _with(SQL_BUCKET, f"audit AS ({_AUDIT_SQL})") +
          f"SELECT * FROM (SELECT * FROM audit WHERE key_id = {KEY_SHOWN} ORDER BY timestamp DESC, request_id DESC LIMIT 5) t")
def win_key_last_n(spark, sf_dir):
    return K.last_n(K.audit_rows(checked(spark, sf_dir)), 5, key=_shown_key())


@register("win_audit_last_n", _with(SQL_BUCKET, f"audit AS ({_AUDIT_SQL})") +
          "SELECT * FROM (SELECT * FROM audit ORDER BY timestamp DESC, request_id DESC LIMIT 50) t")
def win_audit_last_n(spark, sf_dir):
    return K.last_n(K.audit_rows(checked(spark, sf_dir)), 50)


CAP, KEEP = 1000, 500


@register("win_audit_retain", _with(SQL_BUCKET, f"audit AS ({_AUDIT_SQL})") +
          "SELECT timestamp, action, key_id, user, ip_address, success, details, request_id FROM "
          "(SELECT *, row_number() OVER (ORDER BY timestamp DESC, request_id DESC) AS rn, count(*) OVER () AS n FROM audit) t "
          f"WHERE rn <= CASE WHEN n <= {CAP} THEN n ELSE {KEEP} + (n - {CAP} - 1) % ({CAP} - {KEEP} + 1) END")
def win_audit_retain(spark, sf_dir):
    return K.retain_tail(K.audit_rows(checked(spark, sf_dir)), CAP, KEEP, rows=fixture(spark, sf_dir, "request_log").count())


# --- streams -----------------------------------------------------------------

def _landed_requests(spark, sf_dir):
    """Request log landed as parquet files in a shared scratch folder."""
    return landed_once(spark, sf_dir, "request-log", lambda: _land_requests_now(spark, sf_dir))


def _land_requests_now(spark, sf_dir):
    path = scratch_path(spark, "request-log")
    fixture(spark, sf_dir, "request_log").hint("rebalance").write.parquet(path)
    return path, spark.read.parquet(path).schema


@register("stream_classify", _with() + "SELECT request_id, key_id, status FROM classified")
def stream_classify(spark, sf_dir):
    path, schema = _landed_requests(spark, sf_dir)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)
    out = ST.classify_stream(stream, registry(spark, sf_dir)).select("request_id", "key_id", "status")
    sink, ck = scratch_path(spark, "classify-sink"), scratch_path(spark, "classify-ck")
    ST.run_available_now(out, sink, ck)
    return spark.read.parquet(sink)


@register("stream_audit", _with(SQL_BUCKET) + _AUDIT_SQL)
def stream_audit(spark, sf_dir):
    """Audit rows of every request, from the stream running all four rules (rules 1-3
    stateless, the bucket stateful and by event time), over a log arriving out of order."""
    out = ST.audit_stream(ST.validate_stream(_arriving(spark, sf_dir), registry(spark, sf_dir), clock(), in_order=True))
    return _stream_result(out, "audit")


# Requests arrive up to JITTER_US late, in files of SLICE_US each; both together stay within the watermark.
JITTER_US, ARRIVAL_SLICE_US, WATERMARK = 240_000_000, 240_000_000, "10 minutes"


def _arriving(spark, sf_dir):
    """The request log as a stream whose files hold it out of order, a heartbeat at the end. A
    micro-batch takes as many files as a slice has: their number follows the log's span, not its rows."""
    path, schema, files = landed_once(spark, sf_dir, "request-log-arriving", lambda: _land_arriving_now(spark, sf_dir))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _land_arriving_now(spark, sf_dir):
    """Lands one slice of the arrival clock after the other, each by all tasks that hold rows of
    it: the files come in the order of arrival, and their number grows with the log."""
    log = fixture(spark, sf_dir, "request_log")
    arrival = clock() + F.pmod(F.xxhash64("request_id"), F.lit(JITTER_US))
    log = log.withColumn("_slice", F.floor(arrival / F.lit(ARRIVAL_SLICE_US)))
    path = scratch_path(spark, "request-log-arriving")
    first, last = log.agg(F.min("_slice"), F.max("_slice")).first()
    for i in range(*((first, last + 1) if first is not None else (0, 0))):
        log.filter(F.col("_slice") == i).drop("_slice").write.mode("append").parquet(path)
    slices = 0 if first is None else last + 1 - first
    files = max(1, -(-len(spark.read.parquet(path).inputFiles()) // slices)) if slices else 1
    ST.heartbeat(log.drop("_slice")).write.mode("append").parquet(path)
    return path, spark.read.parquet(path).schema, files


def _stream_result(out, name):
    spark = out.sparkSession
    sink, ck = scratch_path(spark, f"{name}-sink"), scratch_path(spark, f"{name}-ck")
    ST.run_available_now(out, sink, ck, state_partitions=STREAM_PARTITIONS)
    return spark.read.schema(out.schema).parquet(sink)


@register("stream_rate_limit", _with(SQL_BUCKET) +
          "SELECT request_id, allowed FROM checked WHERE status = 'pending'")
def stream_rate_limit(spark, sf_dir):
    """Stream bucket decisions by event time over several micro-batches of a log that arrives out of
    order; tests check they equal ``batch_rate_limit``."""
    stream = ST.with_event_time(_arriving(spark, sf_dir), clock(), WATERMARK)
    return _stream_result(ST.rate_limit_in_order(ST.classify_stream(stream, registry(spark, sf_dir))), "bucket").select("request_id", "allowed")


# --- keys that change in mid log -------------------------------------------------

def _changing_keys(spark, sf_dir):
    """Registry with some limits of 0, and its changes."""
    n = F.substring("plain_key", 5, 100).cast("int")
    keys = fixture(spark, sf_dir, "api_keys").withColumn("rate_limit", F.when(n % 11 == 0, 0).otherwise(F.col("rate_limit")))
    changes = fixture(spark, sf_dir, "key_changes").withColumn("key_id", K.key_id(K.key_hash("plain_key"))).drop("plain_key")
    return K.key_registry(keys), changes


SQL_CHANGING = (
    SQL_REGISTRY.replace("rate_limit,", "CASE WHEN CAST(substr(plain_key, 5) AS INT) % 11 = 0 THEN 0 ELSE rate_limit END AS rate_limit,"),
    "changes AS (SELECT substr(sha256(plain_key), 1, 8) AS key_id, seq, action, changed_at, rate_limit FROM key_changes)",
    "judged AS (SELECT r.request_id, r.ts, g.key_hash, g.key_id, g.expires_at, "
    "coalesce((SELECT c.rate_limit FROM changes c WHERE c.key_id = g.key_id AND c.action = 'update' AND c.rate_limit <> 0 "
    "AND c.changed_at <= CAST(r.ts AS TIMESTAMP) ORDER BY c.changed_at DESC, c.seq DESC LIMIT 1), g.rate_limit) AS rate_limit, "
    "coalesce(g.is_active, false) AND NOT EXISTS (SELECT 1 FROM changes c WHERE c.key_id = g.key_id AND c.action = 'revoke' "
    "AND c.changed_at <= CAST(r.ts AS TIMESTAMP)) AS is_active "
    "FROM request_log r LEFT JOIN registry g ON sha256(r.presented_key) = g.key_hash)",
    "classified AS (SELECT *, CASE WHEN key_hash IS NULL THEN 'invalid' WHEN NOT is_active THEN 'revoked' "
    "WHEN coalesce(CAST(ts AS TIMESTAMP) > expires_at, false) THEN 'expired' ELSE 'pending' END AS status FROM judged)",
    SQL_BUCKET)


def _changing_sql(body: str) -> str:
    return sql_with(("request_log", "api_keys", "key_changes"), *SQL_CHANGING).replace("WITH ", "WITH RECURSIVE ", 1) + body


@register("batch_key_changes", _changing_sql(
    "SELECT request_id, key_id, final_status AS status, CAST(CASE WHEN key_hash IS NULL THEN -1 ELSE rate_limit END AS BIGINT) AS rate_limit FROM checked"))
def batch_key_changes(spark, sf_dir):
    """Every request judged by its key as it was then: revocations, limits changed in mid log, limits of 0."""
    reg, changes = _changing_keys(spark, sf_dir)
    cl = KV.classify_as_of(fixture(spark, sf_dir, "request_log"), reg, changes)
    return K.apply_rate_limit(cl, clock()).select("request_id", "key_id", "status", F.coalesce("rate_limit", F.lit(-1).cast("long")).alias("rate_limit"))


@register("stream_key_changes", _changing_sql("SELECT request_id, key_id, final_status AS status FROM checked"))
def stream_key_changes(spark, sf_dir):
    """The same decisions from the stream, over a log arriving out of order."""
    reg, changes = _changing_keys(spark, sf_dir)
    out = ST.validate_stream(_arriving(spark, sf_dir), reg, clock(), changes=changes, in_order=True)
    return _stream_result(out.select("request_id", "key_id", "status"), "key-changes")


# --- keys that never pause -------------------------------------------------------

# Two thirds of all requests go to two keys without a 61 s pause: one far over its limit, one mostly under it.
SQL_ENDLESS = ("endless AS (SELECT request_id, ts, CASE CAST(substr(presented_key, 5) AS INT) % 3 WHEN 0 THEN 'over' WHEN 1 THEN 'under' "
               "ELSE presented_key END AS key_hash, CASE CAST(substr(presented_key, 5) AS INT) % 3 WHEN 0 THEN 6 WHEN 1 THEN 400 "
               "ELSE 1 + CAST(substr(presented_key, 5) AS INT) % 5 END AS rate_limit FROM request_log), "
               "classified AS (SELECT *, 'pending' AS status FROM endless)")


@register("batch_endless_keys", sql_with(("request_log",), SQL_ENDLESS, SQL_BUCKET).replace("WITH ", "WITH RECURSIVE ", 1) +
          "SELECT request_id, allowed, round(tokens_after, 6) AS tokens_after FROM checked")
def batch_endless_keys(spark, sf_dir):
    n = F.substring("presented_key", 5, 100).cast("int")
    log = fixture(spark, sf_dir, "request_log").select(
        "request_id", clock().alias("clock_us"), F.when(n % 3 == 0, "over").when(n % 3 == 1, "under").otherwise(F.col("presented_key")).alias("key_hash"),
        F.when(n % 3 == 0, 6).when(n % 3 == 1, 400).otherwise(1 + n % 5).alias("rate_limit"))
    out = BF.rate_limit_blocks(log, slice_us=45_000_000)
    return out.select("request_id", "allowed", F.round("tokens_after", 6).alias("tokens_after"))


# The audit log's own bounds, over a log with two rows a request.
_TWO_AUDITS = "two AS (SELECT * FROM audit UNION ALL SELECT * REPLACE (request_id + 1000000000 AS request_id) FROM audit)"


@register("win_audit_retain_bounds", _with(SQL_BUCKET, f"audit AS ({_AUDIT_SQL})", _TWO_AUDITS) +
          "SELECT timestamp, action, key_id, user, ip_address, success, details, request_id FROM "
          "(SELECT *, row_number() OVER (ORDER BY timestamp DESC, request_id DESC) AS rn, count(*) OVER () AS n FROM two) t "
          "WHERE rn <= CASE WHEN n <= 10000 THEN n ELSE 5000 + (n - 10000 - 1) % (10000 - 5000 + 1) END")
def win_audit_retain_bounds(spark, sf_dir):
    """The retained tail at the default bounds, of an audit log with two rows a request."""
    audit = K.audit_rows(checked(spark, sf_dir))
    ids = F.explode(F.array(F.col("request_id"), F.col("request_id") + 1_000_000_000))
    return K.retain_tail(audit.withColumn("request_id", ids), rows=2 * fixture(spark, sf_dir, "request_log").count())

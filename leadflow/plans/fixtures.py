"""Fixture tables derived from the driver's test data.

Each fixture is one SQL text over the base tables. The same text builds the
Spark DataFrame (base tables passed as DataFrame arguments, so no global
views are registered) and the DuckDB oracle CTE, so both engines start from
identical rows. The work of every fixture grows with the base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")

FIXTURE_SQL = {
    "leads": """
SELECT CAST(o_orderkey AS STRING) AS item_id, 'Lead ' || CAST(o_orderkey AS STRING) AS item_name, o_orderkey AS seq,
 CASE o_orderkey % 7 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'unqualified' WHEN 2 THEN 'won' WHEN 3 THEN 'cancelled' WHEN 4 THEN 'noshow' WHEN 5 THEN 'proposal' ELSE 'lost' END AS stage,
 CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE c_mktsegment || '-' || CAST(c_nationkey % 4 AS STRING) END AS owner,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE c_name END AS email,
 CASE WHEN o_orderkey % 53 = 0 THEN 'not a date' WHEN o_orderkey % 5 = 0 THEN d || 'T23:30:00-05:00' WHEN o_orderkey % 5 = 1 THEN d || ' 14:05'
  WHEN o_custkey % 24 = 2 THEN replace(d, '-', '') WHEN o_custkey % 24 = 3 THEN substr(d, 1, 4) || '-' || mo || '-' || dy
  WHEN o_custkey % 24 = 4 THEN mo || '/' || dy || '/' || substr(d, 1, 4) WHEN o_custkey % 24 = 5 THEN substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(mo AS INT) * 3 - 2, 3) || ' ' || dy || ', ' || substr(d, 1, 4)
  WHEN o_custkey % 24 = 6 THEN substr(d, 6) || '-' || substr(d, 1, 4) WHEN o_custkey % 24 = 7 THEN d || ' 10:00 PM'
  WHEN o_custkey % 24 = 8 THEN substr(d, 6, 2) || '/' || substr(d, 9) || '/' || substr(d, 1, 4) || ' 10:00' WHEN o_custkey % 24 = 9 THEN dy || '/' || mo || '/' || substr(d, 1, 4)
  WHEN o_custkey % 24 = 10 THEN dy || '-' || substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(mo AS INT) * 3 - 2, 3) || '-' || substr(d, 1, 4) WHEN o_custkey % 24 = 11 THEN substr(d, 1, 4) || '/' || mo || '/' || dy
  WHEN o_custkey % 24 = 12 THEN substr(d, 1, 4) || '-' || substr(d, 6, 2) || '-31' ELSE d END AS date_created,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) AS STRING) END AS sales_call_date,
 CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) END AS deal_value,
 CASE o_orderkey % 4 WHEN 0 THEN 'google-ads' WHEN 1 THEN 'linkedin' WHEN 2 THEN '' ELSE NULL END AS utm_source,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'camp-' || CAST(o_custkey % 12 AS STRING) END AS utm_campaign,
 o_orderpriority AS utm_content
FROM (SELECT *, CAST(CAST(substr(d, 6, 2) AS INT) AS STRING) AS mo, CAST(CAST(substr(d, 9, 2) AS INT) AS STRING) AS dy
 FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM {orders}) o1) o2 JOIN {customer} ON o_custkey = c_custkey""",
    "bookings": """
SELECT 'events/' || CAST(event_id AS STRING) AS uri, event_type AS name, CASE WHEN event_id % 5 = 0 THEN 'canceled' ELSE 'active' END AS status,
 ts AS start_time,
 CASE WHEN user_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'types/ce-1' ELSE 'types/ce-2' END WHEN user_id % 3 = 1 THEN 'types/cc-1' WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'types/ce-1' WHEN event_type = 'signup' THEN 'types/cc-1' ELSE 'types/other' END AS event_type
FROM {events}""",
    "invitees": """
SELECT 'events/' || CAST(event_id AS STRING) AS event_uri, 'invitees/' || CAST(event_id AS STRING) || '-' || CAST(n AS STRING) AS uri, n AS pos,
 CASE WHEN (event_id + n) % 6 = 0 THEN 'canceled' ELSE 'active' END AS status,
 CASE WHEN event_id % 31 = 0 THEN NULL ELSE c_name END AS email, c_name AS name,
 'Zone/' || CAST(user_id % 15 AS STRING) AS timezone, ts AS created_at,
 CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'src-' || CAST(user_id % 4 AS STRING) END AS utm_source,
 'med-' || CAST(user_id % 3 AS STRING) AS utm_medium, 'camp-' || CAST(user_id % 12 AS STRING) AS utm_campaign
FROM {events} JOIN {customer} ON user_id = c_custkey CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) k
WHERE event_id % 9 <> 0 AND (n = 1 OR event_id % 4 = 0)""",
    "members": """
SELECT 'users/' || CAST(s_suppkey AS STRING) AS user_uri, s_name AS name, CAST(s_suppkey AS STRING) || '@example.com' AS email,
 CASE WHEN s_suppkey % 10 = 0 THEN 'owner' WHEN s_suppkey % 10 = 1 THEN 'admin' ELSE 'user' END AS role,
 CASE WHEN s_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status, n_name AS organization
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "event_types": """
SELECT 'types/' || CAST(p_partkey AS STRING) AS uri, p_name AS name, p_size % 3 <> 0 AS active, p_brand AS type, p_type AS kind,
 CASE WHEN p_partkey % 29 = 0 THEN 'bad' ELSE CAST(p_size AS STRING) END AS duration,
 CASE WHEN p_partkey % 3 = 0 THEN 'organization' ELSE 'user' END AS owner_type,
 CASE WHEN p_partkey % 3 = 0 THEN 'organizations/1' ELSE 'users/' || CAST(p_partkey % 80 AS STRING) END AS owner_uri,
 CASE WHEN p_partkey % 37 = 0 THEN 'bad' ELSE CAST(CAST('2023-01-01' AS DATE) + CAST(p_partkey % 700 AS INT) AS STRING) || 'T08:00:00Z' END AS created_at,
 CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE CAST(CAST('2024-12-01' AS DATE) + CAST(p_partkey % 300 AS INT) AS STRING) || 'T09:30:00.250Z' END AS updated_at
FROM {part}""",
    "qa": """
SELECT conv_id, turn, 'Q' || CAST((conv_id + turn) % 6 AS STRING) AS question, text AS answer
FROM {conversations}""",
    "request_log": """
SELECT event_id AS request_id, ts, 'key-' || CAST(user_id AS STRING) AS presented_key, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 429 ELSE 200 END AS http_status, value AS response_time
FROM {events}""",
    "api_keys": """
SELECT 'key-' || CAST(c_custkey AS STRING) AS plain_key, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'read_only' WHEN 1 THEN 'standard' ELSE 'admin' END AS permission,
 c_acctbal >= 0 AS is_active, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(CAST('2024-01-10' AS DATE) + CAST(c_custkey % 60 AS INT) AS TIMESTAMP) END AS expires_at,
 1 + c_custkey % 3 AS rate_limit
FROM {customer} WHERE c_custkey % 15 <> 7""",
    # Limit changes and revocations in the middle of the request log; a limit of 0 changes nothing.
    "key_changes": "\nUNION ALL ".join(
        f"SELECT 'key-' || CAST(c_custkey AS STRING) AS plain_key, {seq} AS seq, '{action}' AS action, CAST('{at}' AS TIMESTAMP) AS changed_at, "
        f"{limit} AS rate_limit FROM {{customer}} WHERE {where}"
        for seq, action, at, limit, where in (
            (1, "update", "2024-01-09 12:00:00", "1 + (c_custkey + 1) % 4", "c_custkey % 3 = 0"),
            (1, "update", "2024-01-17 06:30:00", "0", "c_custkey % 6 = 0"),
            (1, "update", "2024-01-20 00:00:00", "5", "c_custkey % 5 = 0"),
            (2, "update", "2024-01-20 00:00:00", "2", "c_custkey % 10 = 0"),
            (1, "revoke", "2024-01-24 18:00:00", "CAST(NULL AS INT)", "c_custkey % 7 = 1"))),
}

# Spark text of a fixture where it differs from the shared one: the two
# invitees per event come from ``explode`` instead of a cross join.
SPARK_FIXTURE_SQL = {
    "invitees": FIXTURE_SQL["invitees"].replace(
        "CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) k", "LATERAL VIEW explode(array(1, 2)) k AS n"),
}

FIXTURE_TABLES = {
    "leads": ("orders", "customer"),
    "bookings": ("events",),
    "invitees": ("events", "customer"),
    "members": ("supplier", "nation"),
    "event_types": ("part",),
    "qa": ("conversations",),
    "request_log": ("events",),
    "api_keys": ("customer",),
    "key_changes": ("customer",),
}

# Event-type uri -> origin label for the fixture bookings.
FIXTURE_TYPE_ORIGINS = {
    "cold-email": ("types/ce-1", "types/ce-2"),
    "cold-calling": ("types/cc-1",),
}

# Compressed request clock: microseconds / 3000 gives dense per-key traffic.
CLOCK_DIVISOR = 3000


_BASE_CACHE: dict = {}


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reader DataFrame of one base table (plan only, no data cached); reused
    per session so the file listing and footer read happen once."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), spark.sparkContext.applicationId, path)
    df = _BASE_CACHE.get(key)
    if df is None:
        df = _BASE_CACHE[key] = spark.read.parquet(path)
    return df


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build one fixture DataFrame from the base tables in ``sf_dir`` (the
    analyzed plan is reused per session; no data is cached)."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"), "fixture:" + name)
    df = _BASE_CACHE.get(key)
    if df is None:
        tables = {t: base_table(spark, sf_dir, t) for t in FIXTURE_TABLES[name]}
        df = _BASE_CACHE[key] = spark.sql(SPARK_FIXTURE_SQL.get(name, FIXTURE_SQL[name]), **tables)
    return df


def duck_fixture_cte(*names: str) -> str:
    """``WITH`` clause defining the named fixtures over DuckDB's views."""
    parts = []
    for n in names:
        body = FIXTURE_SQL[n].format(**{t: t for t in FIXTURE_TABLES[n]})
        parts.append(f"{n} AS ({body}\n)")
    return "WITH " + ",\n".join(parts) + "\n"

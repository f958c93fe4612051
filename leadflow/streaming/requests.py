"""Structured Streaming jobs over an arriving request log.

* :func:`classify_stream` - key rules 1-3 as a stream-static join.
* :func:`rate_limit_stream` - the token bucket per key in order of arrival: decisions
  come with the micro-batch; an older request refills nothing and leaves the refill clock, so it
  equals the batch job when each key's rows arrive in order.
* :func:`rate_limit_in_order` - the same by event time (:mod:`leadflow.streaming.ordered`):
  rows are held back until the watermark has passed them, and the decisions are the batch job's for any
  order of arrival within the watermark.
* :func:`validate_stream` - all four rules, one status per request; with ``changes``, keys are
  judged as they were at each request.
* :func:`audit_stream` - audit rows from the checked stream.

A bucket idle for 61 s is full again, so its state is dropped on an event-time timer. Rows older
than the watermark are dropped by Spark before they reach the bucket; :func:`late_requests`
gives them back from the landed log and the stream's output.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadflow.functions.columns import key_id
from leadflow.operators import keys as K
from leadflow.operators.key_versions import classify_as_of
from leadflow.operators.ratelimit import SESSION_GAP_US
from leadflow.streaming.ordered import fold_run, rate_limit_by_event_time

STATE_SCHEMA = "tokens double, last long"
OUT_SCHEMA = "request_id long, allowed boolean, tokens_after double"
CARRY = ("key_id", "ts")            # carried through the bucket when present
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def classify_stream(requests: DataFrame, registry: DataFrame, **kw) -> DataFrame:
    """Rules 1-3 on a streaming request frame joined to the static registry."""
    return K.classify_requests(requests, registry, **kw)


def _bucket_fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["clock_us", "request_id"])
    tokens, last = (state.get if state.exists else (None, 0))
    clocks = rows["clock_us"].to_numpy(dtype=np.int64)
    if tokens is not None:
        clocks = np.maximum(clocks, last)       # an older request refills nothing
    allowed, after = fold_run(clocks, rows["rate_limit"].to_numpy(dtype=np.int64), tokens, last)
    tokens, last = float(after[-1]), int(clocks[-1])
    state.update((tokens, int(last)))
    # Bucket full again 61 s after the last request: state can go.
    state.setTimeoutTimestamp(int(last // 1000) + SESSION_GAP_US // 1000)
    out = pd.DataFrame({"request_id": rows["request_id"].astype("int64").to_numpy(),
                        "allowed": allowed, "tokens_after": after})
    for c in CARRY:
        if c in rows.columns:
            out[c] = rows[c].to_numpy()
    yield out


def rate_limit_stream(pending: DataFrame, watermark: str = "10 minutes",
                      key: str = "key_hash") -> DataFrame:
    """Token bucket over pending requests (columns request_id, key_hash,
    rate_limit, clock_us; ``key_id`` and ``ts`` are carried along when
    present)."""
    carry = [c for c in CARRY if c in pending.columns]
    ev = pending.select("request_id", key, "rate_limit", "clock_us", *carry,
                        F.timestamp_micros("clock_us").alias("clock_ts"))
    schema = OUT_SCHEMA + "".join(
        f", {c} {'timestamp' if c == 'ts' else 'string'}" for c in carry)
    return (ev.withWatermark("clock_ts", watermark)
              .groupBy(key)
              .applyInPandasWithState(_bucket_fn, schema, STATE_SCHEMA, "append",
                                      GroupStateTimeout.EventTimeTimeout))


def with_event_time(requests: DataFrame, clock: Column, watermark: str) -> DataFrame:
    """Adds ``clock_us`` and the event time ``clock_ts`` with its watermark. It goes on the whole stream,
    before any filter, so that every request and heartbeat moves it on."""
    return (requests.withColumn("clock_us", clock).withColumn("clock_ts", F.timestamp_micros("clock_us"))
            .withWatermark("clock_ts", watermark))


def rate_limit_in_order(classified: DataFrame) -> DataFrame:
    """Token bucket by event time over the pending requests of a classified stream that has
    :func:`with_event_time`; rows without a request id are heartbeats."""
    return rate_limit_by_event_time(classified.filter((F.col("status") == K.STATUS_PENDING) | F.col("request_id").isNull()))


def validate_stream(requests: DataFrame, registry: DataFrame, clock: Column, watermark: str = "10 minutes",
                    changes: DataFrame | None = None, in_order: bool = False, **kw) -> DataFrame:
    """All four key rules on a stream: rejections by rules 1-3 pass straight
    through, the rest go through the stateful bucket; one output row per
    request with ``status`` (same values as the batch job)."""
    def classify(rows: DataFrame) -> DataFrame:
        return classify_stream(rows, registry, **kw) if changes is None else classify_as_of(rows, registry, changes, **kw)

    cols = ["request_id", "key_id", "ts", "status"]
    if in_order:
        cl = classify(with_event_time(requests, clock, watermark))
        decided = rate_limit_in_order(cl).withColumn("key_id", key_id(F.col("key_hash")))
    else:
        cl = classify(requests).withColumn("clock_us", clock)
        decided = rate_limit_stream(cl.filter(F.col("status") == K.STATUS_PENDING), watermark)
    rejected = cl.filter((F.col("status") != K.STATUS_PENDING) & F.col("request_id").isNotNull()).select(*cols)
    decided = decided.withColumn("status", F.when(F.col("allowed"), F.lit(K.STATUS_OK))
                                            .otherwise(F.lit(K.STATUS_LIMITED))).select(*cols)
    return rejected.unionByName(decided)


def heartbeat(log: DataFrame, ts_col: str = "ts", days: int = 365) -> DataFrame:
    """One row of the log's columns, all null but a time ``days`` after its last request: landed behind a
    log that has ended, it lets the held-back rows out."""
    end = log.agg((F.max(ts_col) + F.expr(f"INTERVAL {days} DAYS")).cast(log.schema[ts_col].dataType).alias(ts_col)).filter(F.col(ts_col).isNotNull())
    return end.select(*[F.col(ts_col) if f.name == ts_col else F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema.fields])


def late_requests(landed: DataFrame, checked: DataFrame, rid: str = "request_id") -> DataFrame:
    """Landed requests to which the stream gave no status: those that came later
    than the watermark. A batch job, run after the stream (or a batch of it);
    its result is the late-rows output, to audit or to check anew."""
    return landed.join(checked.select(rid), rid, "left_anti")


def audit_stream(checked: DataFrame, **kw) -> DataFrame:
    return K.audit_rows(checked, **kw)


def run_available_now(df: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet",
                      mode: str = "append", timeout_s: int | None = None,
                      state_partitions: int | None = None) -> None:
    """Run a streaming frame over everything available, then stop.

    ``state_partitions``: shuffle/state partitions of a *new* stateful query
    (Spark fixes them in the checkpoint at the first batch). State is kept in RocksDB. The session
    settings are restored afterwards.
    """
    spark = df.sparkSession
    settings = {STATE_STORE: ROCKSDB}           # bounded heap, and what transformWithState needs
    if state_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start(sink))
        q.awaitTermination(*([] if timeout_s is None else [timeout_s]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not finish")
    if q.exception():
        raise q.exception()


def with_clock(df: DataFrame, clock: Column) -> DataFrame:
    return df.withColumn("clock_us", clock)

"""The token bucket of a stream, folded by event time.

Rows of a key are held back in slots of the clock until the watermark has passed their
slot; then no older row can come any more, and the slot is folded in (key, clock, id) order by the
same vectorized fold as the batch job. The decisions are thus those of the batch job for
any order of arrival within the watermark.

Keys are dealt to ``shards`` by hash, and state and timers belong to a shard: a call to the state
store costs the same for one row as for thousands, so a micro-batch makes as many calls as it has
shards and slots, not keys. State per shard: the open buckets of its keys and the slots not yet passed,
each with its rows as Arrow bytes. One event-time timer per slot folds it (and any before it); a last one
drops the buckets that are full again, 61 s after their newest row. A row costs one rewrite of its
own slot, not of all that is held back; a fold holds one slot of one shard in memory.

Spark tells time by the rows it has seen: the slots after the last watermark are folded only
when later rows arrive. A *heartbeat* (a row without a request id, of any key, with a
clock) makes time pass on a quiet stream; it takes no token and gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leadflow.operators.ratelimit import SESSION_GAP_US, fold_sorted

#: Width of a slot of the clock.
SLOT_US = 30_000_000
#: Keys are dealt to this many shards of state.
SHARDS = 128
_COLUMNS = ("clock_us", "request_id", "rate_limit", "ts_us")


def fold_run(clocks: np.ndarray, limits: np.ndarray, tokens: float | None, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(allowed, tokens after) of sorted requests of one key that follow a bucket of ``tokens`` at
    clock ``last`` (None: a new, full one)."""
    pause = np.diff(clocks, prepend=clocks[0] - SESSION_GAP_US if tokens is None else last) >= SESSION_GAP_US
    sessions = np.cumsum(pause)
    state = {} if tokens is None else {"key": 0, "session": 0, "tokens": tokens, "last": last}
    return fold_sorted(np.zeros(len(clocks), np.int64), sessions, clocks, limits, state)


def _pack(columns: dict) -> bytes:
    t = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> pa.Table:
    """The rows of one or several packed tables, one after the other."""
    src = pa.BufferReader(raw)
    parts = []
    while src.tell() < len(raw):
        parts.append(pa.ipc.open_stream(src).read_all())
    return pa.concat_tables(parts)


def fold_slot(rows: pa.Table, buckets: dict[str, tuple[float, int]]) -> pd.DataFrame:
    """Decisions of the rows of many keys that follow ``buckets`` (key -> tokens at clock; absent: full), which
    are brought up to date."""
    t = rows.sort_by([("key_hash", "ascending"), ("clock_us", "ascending"), ("request_id", "ascending")])
    keys = t["key_hash"].to_numpy()
    clocks, ids, limits, times = (t[c].to_numpy() for c in _COLUMNS)
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(keys)) - 1
    sessions = np.cumsum(np.diff(clocks, prepend=clocks[0]) >= SESSION_GAP_US)
    opened = {}
    for i in begin.tolist():
        before = buckets.get(keys[i])
        if before is not None and clocks[i] - before[1] < SESSION_GAP_US:
            opened[i] = before
    allowed, after = fold_sorted(np.cumsum(first), sessions, clocks, limits, {}, opened)
    buckets.update(zip(keys[begin].tolist(), zip(after[end].tolist(), clocks[end].tolist())))
    return pd.DataFrame({"request_id": ids, "allowed": allowed, "tokens_after": after, "key_hash": keys, "ts_us": times})


class OrderedBucket(StatefulProcessor):
    """State and timers of one shard of keys."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getValueState("buckets", "rows binary")
        self.slots = handle.getMapState("slots", "slot long", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [pdf[pdf["request_id"].notna() & pdf["clock_us"].notna()] for pdf in rows]
        new = pd.concat(parts, ignore_index=True)
        for slot, part in new.groupby(new["clock_us"] // SLOT_US):
            raw = _pack({"key_hash": pa.array(part["key_hash"], pa.string()), **{c: pa.array(part[c].astype("int64").to_numpy()) for c in _COLUMNS}})
            at = (int(slot),)
            if self.slots.containsKey(at):
                raw = bytes(self.slots.getValue(at)[0]) + raw
            else:
                self.handle.registerTimer(self._end_ms(int(slot)))
            self.slots.updateValue(at, (raw,))
        return iter(())

    @staticmethod
    def _end_ms(slot: int) -> int:
        return (slot + 1) * SLOT_US // 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted(s for (s,) in self.slots.keys() if self._end_ms(s) <= now)
        buckets = {}
        if self.buckets.exists():
            t = _unpack(bytes(self.buckets.get()[0]))
            buckets = dict(zip(t["key"].to_pylist(), zip(t["tokens"].to_pylist(), t["last"].to_pylist())))
        elif not due:
            return
        for slot in due:
            yield fold_slot(_unpack(bytes(self.slots.getValue((slot,))[0])), buckets)
            self.slots.removeKey((slot,))
        # No row still to come is older than this slot: a bucket 61 s before it is full again.
        edge = now * 1000 // SLOT_US * SLOT_US
        live = {k: b for k, b in buckets.items() if edge - b[1] < SESSION_GAP_US}
        if not live:
            self.buckets.clear()
        elif due or len(live) < len(buckets):
            tokens, last = zip(*live.values())
            self.buckets.update((_pack({"key": list(live), "tokens": pa.array(tokens, pa.float64()), "last": pa.array(last, pa.int64())}),))
            self.handle.registerTimer((max(last) + SESSION_GAP_US + SLOT_US) // 1000 + 1)

    def close(self) -> None:
        pass


OUT_SCHEMA = "request_id long, allowed boolean, tokens_after double, key_hash string, ts_us long"


def rate_limit_by_event_time(pending: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(request_id, allowed, tokens_after, key_hash, ts) of a stream with columns request_id (null: a
    heartbeat), key_hash, rate_limit, clock_us, ts and the event time ``clock_ts`` that carries the
    stream's watermark. ``shards``: a few for each state partition."""
    key = F.coalesce("key_hash", F.lit(""))
    rows = pending.select("request_id", key.alias("key_hash"), F.col("rate_limit").cast("int").alias("rate_limit"),
                          "clock_us", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "clock_ts",
                          F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"))
    out = (rows.groupBy("shard")
           .transformWithStateInPandas(OrderedBucket(), OUT_SCHEMA, "append", "eventTime"))
    return out.select("request_id", "allowed", "tokens_after", "key_hash", F.timestamp_micros("ts_us").alias("ts"))

"""The bucket by event time, and keys that change while requests come in."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadflow.operators import key_versions as KV
from leadflow.operators import keys as K
from leadflow.operators import ratelimit as RL
from leadflow.session import scratch_path
from leadflow.streaming import ordered as O
from leadflow.streaming import requests as ST

DAY = dt.datetime(2024, 1, 1)


def loop(clocks, limits, tokens, last):
    out = []
    for t, lim in zip(clocks, limits):
        if tokens is None or t - last >= RL.SESSION_GAP_US:
            tokens, last = float(lim), t
        tokens, ok = RL.bucket_step(tokens, last, t, lim)
        last = max(last, t)
        out.append((ok, tokens))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_fold_run_equals_the_loop(seed):
    r = random.Random(seed)
    clocks = np.cumsum([r.choice([0, 1, 300_000, 20_000_000, 61_000_000, 90_000_000]) for _ in range(400)])
    limits = np.array([r.choice([0, 1, 3])] * 200 + [r.choice([0, 2, 5]) for _ in range(200)])
    tokens, last, got = None, 0, []
    cuts = sorted({0, 400, *[r.randrange(400) for _ in range(6)]})
    for a, b in zip(cuts, cuts[1:]):
        allowed, after = O.fold_run(clocks[a:b], limits[a:b], tokens, last)
        got += list(zip(allowed.tolist(), after.tolist()))
        tokens, last = float(after[-1]), int(clocks[b - 1])
    assert got == loop(clocks.tolist(), limits.tolist(), None, 0)


LOG = "request_id long, presented_key string, ts timestamp"


def a_log(n, seed, late_s):
    """(rows in time order, the same in an order of arrival up to ``late_s`` late)."""
    r, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += r.choice([0, 0.2, 2.0, 15.0])
        rows.append((i, r.choice(["a", "b", "c", "unknown", None]), DAY + dt.timedelta(seconds=t)))
    return rows, sorted(rows, key=lambda x: x[2] + dt.timedelta(seconds=r.random() * late_s))


def key_table(spark):
    keys = spark.createDataFrame([("a", "A", True, None, 2), ("b", "B", True, None, 0), ("c", "C", True, DAY + dt.timedelta(minutes=20), 5), ("d", "D", False, None, 1)],
                                 "plain_key string, name string, is_active boolean, expires_at timestamp, rate_limit int")
    return K.key_registry(keys)


CHANGES = "plain_key string, changed_at timestamp, action string, rate_limit int, seq int"


def change_table(spark, rows):
    c = spark.createDataFrame([(k, DAY + dt.timedelta(seconds=s), a, n, q) for k, s, a, n, q in rows], CHANGES)
    return c.withColumn("key_id", K.key_id(K.key_hash("plain_key"))).drop("plain_key")


SOME_CHANGES = [("a", 300, "update", 7, 1), ("a", 300, "update", 1, 2), ("a", 700, "update", 0, 1), ("a", 900, "update", None, 1), ("b", 500, "update", 3, 1),
                ("c", 600, "update", 1, 1), ("c", 1000, "revoke", None, 1), ("c", 1100, "update", 9, 1), ("nobody", 10, "revoke", None, 1), ("d", 50, "update", 4, 1)]


def brute(rows, changes):
    """Every request in time order, with keys changed as time goes by."""
    base = {"a": (True, None, 2), "b": (True, None, 0), "c": (True, 1200, 5), "d": (False, None, 1)}
    buckets, out = {}, {}
    for rid, key, ts in sorted(rows, key=lambda x: (x[2], x[0])):
        at = (ts - DAY).total_seconds()
        if key not in base:
            out[rid] = "invalid"
            continue
        active, expires, limit = base[key]
        for k, s, action, n, _ in sorted(changes, key=lambda c: (c[1], c[4])):
            if k == key and s <= at:
                active = active and action != "revoke"
                limit = n if action == "update" and n else limit
        if not active:
            out[rid] = "revoked"
        elif expires is not None and at > expires:
            out[rid] = "expired"
        else:
            t = int(round(at * 1e6))
            tokens, last = buckets.get(key, (None, 0))
            ((ok, tokens),) = loop([t], [limit], tokens, last)
            buckets[key] = (tokens, t)
            out[rid] = "ok" if ok else "rate_limited"
    return out


@pytest.mark.parametrize("width", [1, 60, 86_400])
def test_changing_keys_batch(spark, width):
    rows, _ = a_log(500, 4, 0)
    cl = KV.classify_as_of(spark.createDataFrame(rows, LOG), key_table(spark), change_table(spark, SOME_CHANGES), width=width)
    got = K.apply_rate_limit(cl, RL.micros_clock("ts"))
    want = brute(rows, SOME_CHANGES)
    assert {r.request_id: r.status for r in got.select("request_id", "status").collect()} == want
    assert set(want.values()) == {"ok", "invalid", "revoked", "expired", "rate_limited"} - ({"expired"} if "expired" not in want.values() else set())


def test_changing_keys_edge_cases(spark):
    rows, _ = a_log(60, 1, 0)
    rows.append((1000, "a", None))
    log, reg, none = spark.createDataFrame(rows, LOG), key_table(spark), change_table(spark, SOME_CHANGES).limit(0)
    as_of = KV.classify_as_of(log, reg, none).select("request_id", "key_id", "status", F.col("rate_limit").cast("int").alias("rate_limit"))
    plain = K.classify_requests(log, reg).select("request_id", "key_id", "status", "rate_limit")
    assert sorted(map(tuple, as_of.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert KV.classify_as_of(log.limit(0), reg, change_table(spark, SOME_CHANGES)).count() == 0
    plan = KV.classify_as_of(log, reg, change_table(spark, SOME_CHANGES))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def stream_of(spark, arrival, files):
    path = scratch_path(spark, "arriving")
    step = -(-len(arrival) // files)
    for i in range(0, len(arrival), step):
        spark.createDataFrame(arrival[i:i + step], LOG).coalesce(1).write.mode("append").parquet(path)
    ST.heartbeat(spark.createDataFrame(arrival, LOG)).write.mode("append").parquet(path)
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)


def test_shuffled_stream_gives_the_batch_decisions(spark):
    """Out of order by up to 5 minutes under a watermark of 6, keys changing meanwhile."""
    rows, arrival = a_log(400, 9, 300)
    assert rows != arrival
    reg, changes = key_table(spark), change_table(spark, SOME_CHANGES)
    out = ST.validate_stream(stream_of(spark, arrival, 6), reg, RL.micros_clock("ts"), watermark="6 minutes", changes=changes, in_order=True)
    sink = scratch_path(spark, "ordered-out")
    ST.run_available_now(out, sink, scratch_path(spark, "ordered-ck"), state_partitions=2)
    got = [(r.request_id, r.status) for r in spark.read.schema(out.schema).parquet(sink).collect()]
    assert len(got) == len(rows) and dict(got) == brute(rows, SOME_CHANGES)


def test_arrival_order_bucket_keeps_its_clock(spark):
    """In order of arrival an older request refills nothing and leaves the refill clock."""
    rows = [(1, "a", DAY + dt.timedelta(seconds=100)), (2, "a", DAY + dt.timedelta(seconds=100)), (3, "a", DAY + dt.timedelta(seconds=70)),
            (4, "a", DAY + dt.timedelta(seconds=131))]
    path = scratch_path(spark, "late")
    for r in rows:
        spark.createDataFrame([r], LOG).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)
    out = ST.validate_stream(stream, key_table(spark), RL.micros_clock("ts"))
    sink = scratch_path(spark, "late-out")
    ST.run_available_now(out, sink, scratch_path(spark, "late-ck"), state_partitions=2)
    assert {r.request_id: r.status for r in spark.read.parquet(sink).collect()} == {1: "ok", 2: "ok", 3: "rate_limited", 4: "ok"}


class FakeState:
    """A state handle that counts the calls made to it."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def getValueState(self, name, schema):
        return FakeValue(self)

    def getMapState(self, name, key, schema):
        return FakeMap(self)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class FakeValue:
    def __init__(self, state):
        self.state = state

    def exists(self):
        self.state.calls += 1
        return self.state.value is not None

    def get(self):
        self.state.calls += 1
        return self.state.value

    def update(self, value):
        self.state.calls += 1
        self.state.value = value

    def clear(self):
        self.state.value = None


class FakeMap:
    def __init__(self, state):
        self.state = state

    def keys(self):
        self.state.calls += 1
        return [*self.state.map]

    def containsKey(self, k):
        self.state.calls += 1
        return k in self.state.map

    def getValue(self, k):
        self.state.calls += 1
        return self.state.map[k]

    def updateValue(self, k, v):
        self.state.calls += 1
        self.state.map[k] = v

    def removeKey(self, k):
        self.state.calls += 1
        del self.state.map[k]


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_state_calls_follow_slots_not_keys():
    """A thousand keys in shuffled batches with watermarks in between: the loop's decisions, and calls to the
    state by slot and batch."""
    r = random.Random(7)
    rows = [(i, f"k{r.randrange(1000)}", r.choice([0, 17, 90, 200]) * 1_000_000 + r.randrange(3_000_000)) for i in range(6000)]
    state, bucket, got = FakeState(), O.OrderedBucket(), {}
    bucket.init(state)
    arrival = sorted(rows, key=lambda x: x[2] + r.random() * 50_000_000)
    for lo in range(0, len(arrival), 1500):
        part = arrival[lo:lo + 1500]
        pdf = pd.DataFrame(part, columns=["request_id", "key_hash", "clock_us"]).assign(rate_limit=2, ts_us=0)
        pdf = pd.concat([pdf, pd.DataFrame({"request_id": [None], "key_hash": [""], "clock_us": [1]})], ignore_index=True)
        list(bucket.handleInputRows((0,), iter([pdf]), None))
        now = 10**9 if lo + 1500 >= len(arrival) else (min(x[2] for x in arrival[lo + 1500:]) // 1000)
        for _ in range(sum(t <= now for t in state.timers)):
            for out in bucket.handleExpiredTimer((0,), Watermark(now), None):
                got.update(zip(out["request_id"].tolist(), zip(out["allowed"].tolist(), out["tokens_after"].tolist())))
        state.timers = {t for t in state.timers if t > now}
    want = {}
    for k in {x[1] for x in rows}:
        mine = sorted((x[2], x[0]) for x in rows if x[1] == k)
        want.update(zip([i for _, i in mine], loop([c for c, _ in mine], [2] * len(mine), None, 0)))
    assert got == want and len(got) == 6000
    assert state.calls < 400
    assert not state.map and state.value is None


def test_micro_batches_follow_the_span_not_the_files(spark, tmp_path):
    """The log split over many files arrives in as many micro-batches as it has slices."""
    from leadflow.plans import q_keys as Q
    at = F.lit(DAY).cast("timestamp") + F.make_interval(secs=(F.col("id") % 700).cast("decimal(18,6)") * Q.CLOCK_DIVISOR)
    (spark.range(0, 4200, numPartitions=6).select(F.col("id").alias("event_id"), at.alias("ts"), F.lit(1).cast("long").alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props")).write.parquet(str(tmp_path / "events.parquet")))
    seen = []
    q = Q._arriving(spark, str(tmp_path)).writeStream.foreachBatch(lambda df, i: seen.append(df.count())).trigger(availableNow=True).option(
        "checkpointLocation", scratch_path(spark, "span-ck")).start()
    q.awaitTermination()
    assert sum(seen) == 4201 and 2 <= len(seen) <= 6

"""Per-key token-bucket rate limiting over a request log.

Bucket rule (per key, ``L`` = requests per minute): the bucket starts full;
before each request it refills by ``elapsed_seconds * L / 60`` capped at
``L``; the request is allowed when at least one token is left, and takes
it. A limited request still moves the refill clock.

Parallel plan
-------------
The fold is sequential per key, but a bucket idle for 61 s or more is full
again whatever it held (``61 * L / 60 > L`` even after rounding), so a key's
requests split exactly into independent *sessions* at such gaps. Sessions
are found without gathering a key in one task (the clock is cut into slices,
with one summary row per key and
slice, see :func:`with_sessions`), then hash-distributed by (key, session), sorted
inside each partition, and folded by ``mapInArrow`` that streams Arrow
batches and carries the bucket across batch boundaries, so memory stays
bounded however long a session is. Sessions of one key run in parallel on
different tasks; only one continuous session (no 61 s pause) is inherently
sequential and stays in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A gap this long refills any bucket to full exactly (see module doc).
SESSION_GAP_US = 61_000_000


def bucket_step(tokens: float, last: int, t: int, limit: int) -> tuple[float, bool]:
    """One request against the bucket; returns (tokens after, allowed). A request
    older than the refill clock ``last`` refills nothing."""
    tokens = min(float(limit), tokens + (float(max(0, t - last)) / 1e6) * (limit / 60.0))
    if tokens >= 1.0:
        return tokens - 1.0, True
    return tokens, False


def fold_sorted(keys: np.ndarray, sessions: np.ndarray, clocks: np.ndarray,
                limits: np.ndarray, state: dict, opened: dict[int, tuple[float, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fold rows sorted by (key, session, clock, id). ``state`` carries the
    open bucket ``(key, session, tokens, last)`` across calls; ``opened`` gives the bucket
    (tokens, last) before the first row of a run that does not start full, by its index.

    Vectorized fast path: a run (key, session) starts full, so its first
    request leaves ``L - 1`` tokens; while every following request comes
    after a pause that refills at least one token, the bucket is back at
    ``L`` before each of them (bit for bit: ``min(L, L - 1 + r) == L`` for
    ``r >= 1``), so they are all allowed with ``L - 1`` left. The rows
    after a run's first short pause go through the sequential loop, which leaps to the next
    short pause whenever it finds the bucket full.
    """
    n = len(clocks)
    allowed = np.ones(n, dtype=bool)
    limits_f = limits.astype(np.float64)
    after = limits_f - 1.0
    if n == 0:
        return allowed, after
    same_as_prev = np.zeros(n, dtype=bool)
    same_as_prev[1:] = (keys[1:] == keys[:-1]) & (sessions[1:] == sessions[:-1])
    continues = state.get("key") is not None and keys[0] == state.get("key") and sessions[0] == state.get("session")
    refill = np.zeros(n)
    refill[1:] = ((clocks[1:] - clocks[:-1]).astype(np.float64) / 1e6) * (limits_f[1:] / 60.0)
    # The fast path needs whole tokens and one limit: a limit under 1, a changed
    # limit or a short pause sends the rest of the run through the loop.
    changed = np.zeros(n, dtype=bool)
    changed[1:] = same_as_prev[1:] & (limits[1:] != limits[:-1])
    short = (same_as_prev & (refill < 1.0)) | changed | (limits_f < 1.0)
    run_id = np.cumsum(~same_as_prev)
    # rows at or after the first short pause of their run
    short_before = np.cumsum(short)
    run_start_count = np.zeros(n, dtype=np.int64)
    starts = np.flatnonzero(~same_as_prev)
    run_start_count[starts] = short_before[starts] - short[starts]
    base = np.maximum.accumulate(np.where(~same_as_prev, np.arange(n), 0))
    slow = (short_before - run_start_count[base]) > 0
    if continues:
        slow |= run_id == run_id[0]          # first run continues a bucket from the last batch
    opened = dict(opened or {})
    if continues and 0 not in opened:
        opened[0] = (state.get("tokens", 0.0), state.get("last", 0))
    if opened:
        slow |= np.isin(run_id, run_id[list(opened)])
    hard = np.flatnonzero(short | ~same_as_prev)
    todo = np.flatnonzero(slow)              # from a run's first slow row to its end
    p = 0
    while p < len(todo):
        i = int(todo[p])
        t, lim = int(clocks[i]), int(limits[i])
        if i in opened:
            prev_tokens, prev_last = opened[i]
        elif i == 0 or not same_as_prev[i]:
            prev_tokens, prev_last = float(lim), t
        else:
            prev_tokens, prev_last = after[i - 1], int(clocks[i - 1])
        after[i], allowed[i] = bucket_step(prev_tokens, prev_last, t, lim)
        p += 1
        if lim >= 1 and after[i] == lim - 1.0:
            # It was full: so it is before each row up to the next short pause.
            k = int(np.searchsorted(hard, i + 1))
            leap = (int(hard[k]) if k < len(hard) else n) - (i + 1)
            after[i + 1:i + 1 + leap] = after[i]
            p += leap
    state.update(key=keys[-1], session=sessions[-1], tokens=float(after[-1]), last=int(clocks[-1]))
    return allowed, after


def _fold_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns _k, _s, _t, _l, the request id and the carried ones, sorted."""
    state: dict = {}
    for b in batches:
        if b.num_rows:
            allowed, after = fold_sorted(*[b.column(i).to_numpy(zero_copy_only=False) for i in range(4)], state)
            yield pa.RecordBatch.from_arrays([b.column(4), pa.array(allowed), pa.array(after), *b.columns[5:]],
                                             [b.schema.names[4], "allowed", "tokens_after", *b.schema.names[5:]])


#: Width of the clock slices in which pauses are looked for.
SLICE_US = 3_600_000_000


def with_sessions(requests: DataFrame, key: str, clock: str, rid: str, slice_us: int = SLICE_US) -> DataFrame:
    """Adds ``_session``: the clock of the session's first request, where a
    session ends at a gap of 61 s or more between a key's requests.

    No step gathers a key in one task. The clock is cut into *slices* of
    ``slice_us``; gaps are found inside each (key, slice), and one summary row
    per slice links it to the previous slice of its key. A slice is a function of
    the clock alone, so nothing is counted first, and every branch of the plan
    (and every task retry) agrees on it.
    """
    r = requests.withColumn("_slice", F.floor(F.col(clock) / F.lit(slice_us)).cast("long"))
    w = Window.partitionBy(key, "_slice").orderBy(clock, rid)
    gap = F.col(clock) - F.lag(clock).over(w)
    r = r.withColumn("_new", F.when(gap.isNotNull(), gap >= SESSION_GAP_US))   # null: first of slice
    # One summary row per (key, slice).
    sl = r.groupBy(key, "_slice").agg(F.min(clock).alias("_first"), F.max(clock).alias("_last"),
                                      F.max(F.when(F.col("_new"), F.col(clock))).alias("_last_start"))
    bw = Window.partitionBy(key).orderBy("_slice")
    prev_last = F.lag("_last").over(bw)
    sl = sl.withColumn("_first_new", prev_last.isNull() | ((F.col("_first") - prev_last) >= SESSION_GAP_US))
    cand = F.coalesce(F.col("_last_start"), F.when(F.col("_first_new"), F.col("_first")))
    sl = sl.withColumn("_end_start", F.last(cand, ignorenulls=True).over(
        bw.rowsBetween(Window.unboundedPreceding, 0)))
    sl = sl.withColumn("_begin_start", F.when(F.col("_first_new"), F.col("_first"))
                                        .otherwise(F.lag("_end_start").over(bw)))
    r = r.join(sl.select(key, "_slice", "_first_new", "_begin_start"), [key, "_slice"])
    is_new = F.coalesce(F.col("_new"), F.col("_first_new"))
    running = F.last(F.when(is_new, F.col(clock)), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    return (r.withColumn("_session", F.coalesce(running, F.col("_begin_start")))
             .drop("_slice", "_new", "_first_new", "_begin_start"))


def rate_limit(requests: DataFrame, key: str = "key_hash", clock: str = "clock_us",
               limit: str = "rate_limit", rid: str = "request_id",
               partitions: int | None = None, slice_us: int = SLICE_US,
               carry: Sequence[str] = ()) -> DataFrame:
    """Decide each request: ``(request_id, allowed, tokens_after, *carry)``.

    ``requests`` holds only the requests that reached the bucket (they
    passed the key checks), with the key's ``limit`` on every row and an
    integer microsecond ``clock``. ``carry`` columns go through the fold with
    their row, so nothing is joined back.

    One path for all keys: sessions are found per slice, then hashed by
    (key, session), sorted and folded in parallel (see the module text). Nothing
    runs while the plan is built.
    """
    n = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = requests.select(*dict.fromkeys([key, clock, limit, rid, *carry]))
    s = with_sessions(src, key, clock, rid, slice_us).select(
        F.col(key).alias("_k"), F.col("_session").alias("_s"), F.col(clock).alias("_t"),
        F.col(limit).alias("_l"), F.col(rid).cast("long").alias(rid), *carry)
    schema = s.select(rid).schema.add("allowed", "boolean").add("tokens_after", "double")
    for f in s.select(*carry).schema.fields:
        schema = schema.add(f)
    s = s.repartition(n, "_k", "_s").sortWithinPartitions("_k", "_s", "_t", rid)
    return s.mapInArrow(_fold_partition, schema)


def micros_clock(ts: Column | str, divisor: int = 1) -> Column:
    """Integer microsecond clock of a timestamp (optionally compressed)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    us = F.unix_micros(c.cast("timestamp"))
    return us if divisor == 1 else F.floor(us / F.lit(divisor)).cast("long")

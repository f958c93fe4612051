"""The speculative block fold against the per-row bucket."""

import random

import numpy as np
import pytest

from leadflow.operators import blockfold as BF
from leadflow.operators import ratelimit as RL

LOG = "request_id long, key_hash string, rate_limit int, clock_us long, note string"


def brute(rows):
    buckets, out = {}, {}
    for rid, key, limit, t, _ in sorted(rows, key=lambda r: (r[1] or "", r[3], r[0])):
        tokens, last = buckets.get(key, (float(limit), t))
        if t - last >= RL.SESSION_GAP_US:
            tokens = float(limit)
        tokens, ok = RL.bucket_step(tokens, last, t, limit)
        buckets[key] = (tokens, t)
        out[rid] = (ok, tokens)
    return out


def a_log(seed, n=1500):
    """Endless keys: over the limit, under it, in bursts, with a limit that changes, with a limit of 0; and one that pauses."""
    r, rows = random.Random(seed), []
    gaps = {"over": [100_000, 700_000], "under": [900_000, 1_500_000], "bursts": [1_000] * 30 + [40_000_000], "moves": [400_000, 2_000_000],
            "zero": [1_000_000], "pauses": [500_000, 70_000_000]}
    limits = {"over": 60, "under": 120, "bursts": 45, "zero": 0, "pauses": 2}
    clock = dict.fromkeys(gaps, 0)
    for i in range(n):
        k = r.choice(list(gaps))
        clock[k] += r.choice(gaps[k])
        limit = limits.get(k) or (0 if k == "zero" else 30 + 60 * (clock[k] // 50_000_000 % 3))
        rows.append((i, k, limit, clock[k], f"n{i}"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rounds, batch", [(3, 10_000), (0, 10_000), (1, 7)])
def test_blocks_equal_the_per_row_bucket(spark, rounds, batch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        rows = a_log(rounds + batch)
        got = BF.rate_limit_blocks(spark.createDataFrame(rows, LOG).repartition(3), slice_us=20_000_000, rounds=rounds, carry=["note"])
        assert {r.request_id: (r.allowed, r.tokens_after) for r in got.collect()} == brute(rows)
        assert all(r.note == f"n{r.request_id}" for r in got.collect())
    finally:
        spark.conf.set(key, before)


def narrow(spark, rows, slice_us):
    df = spark.createDataFrame(rows, LOG)
    return df.selectExpr("key_hash AS _k", f"clock_us div {slice_us} AS _c", f"clock_us div {slice_us} AS _b", "clock_us AS _t", "CAST(rate_limit AS LONG) AS _l", "request_id")


def test_a_key_that_fills_its_bucket_spreads_over_blocks(spark):
    """300 blocks of one endless session, each burst refilled before the block's end: no block is folded again
    in order, though blocks start from a guess."""
    r, t, rows = random.Random(1), 0, []
    for i in range(3000):
        t += 1_000 if i % 30 else 45_000_000
        rows.append((i, "k", 60, t + r.randrange(500), "x"))
    assert max(b[3] - a[3] for a, b in zip(rows, rows[1:])) < RL.SESSION_GAP_US
    blocks, folded = BF.settle_blocks(narrow(spark, rows, 15_000_000), "request_id", 8, 3)
    assert blocks.count() > 90 and len(folded) <= 2 and sum(folded) < 40
    want = brute(rows)
    by_id = {r[0]: r for r in rows}
    last = {}
    for rid, (_, tokens) in want.items():
        b = by_id[rid][3] // 15_000_000
        last[b] = max(last.get(b, (-1, 0.0)), (by_id[rid][3], tokens))
    assert {x._b: (x._last, x._end) for x in blocks.collect()} == last


def test_empty_and_one_request(spark):
    none = spark.createDataFrame([], LOG)
    assert BF.rate_limit_blocks(none, slice_us=1_000_000).count() == 0
    one = spark.createDataFrame([(1, "k", 0, 5, "x"), (2, "j", 1, 5, "x")], LOG)
    assert {r.request_id: r.allowed for r in BF.rate_limit_blocks(one).collect()} == {1: False, 2: True}


def test_fold_leaps_over_full_stretches():
    """A run with one burst takes the loop for the burst alone; results as per row."""
    gaps = [2_000_000] * 2000 + [1_000] * 40 + [30_000_000] + [2_000_000] * 20_000
    clocks = np.cumsum(gaps)
    n = len(clocks)
    limits = np.full(n, 60)
    steps = []
    real = RL.bucket_step
    RL.bucket_step = lambda *a: steps.append(1) or real(*a)
    try:
        allowed, after = RL.fold_sorted(np.zeros(n, int), np.zeros(n, int), clocks, limits, {})
    finally:
        RL.bucket_step = real
    want = brute([(i, "k", 60, int(t), "") for i, t in enumerate(clocks)])
    assert [(bool(a), float(x)) for a, x in zip(allowed, after)] == [want[i] for i in range(n)]
    assert len(steps) < 100

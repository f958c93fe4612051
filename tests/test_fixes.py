"""Cases once handled wrongly: bucket limits, page cuts, empty groups and parts, runs of snapshots."""

import datetime as dt
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadflow.functions.metrics import RATIOS, Ratio, ratio_columns, with_ratio
from leadflow.operators import joins as J
from leadflow.operators import ratelimit as RL
from leadflow.operators import transform as T
from leadflow.sinks import writers as W
from leadflow.sources import pages as S
from leadflow.sources import snapshots as SN

SEC = 1_000_000


def test_fold_equals_steps_with_low_and_changing_limits():
    rnd = random.Random(5)
    for _ in range(60):
        rows = []
        for k in range(3):
            t = 0
            for _ in range(40):
                t += rnd.choice([0, SEC, 6 * SEC, 20 * SEC, 61 * SEC])
                rows.append((f"k{k}", t, rnd.choice([0, 0, 1, 3, 10])))
        keys = np.array([r[0] for r in rows], dtype=object)
        state, got, left = {}, [], []
        for lo in range(0, len(rows), 17):
            part = rows[lo:lo + 17]
            a, b = RL.fold_sorted(keys[lo:lo + 17], np.zeros(len(part), np.int64), np.array([r[1] for r in part]),
                                  np.array([r[2] for r in part]), state)
            got += a.tolist()
            left += b.tolist()
        plain, prev = [], {}
        for k, t, lim in rows:
            tokens, last = prev.get(k, (float(lim), t))
            tokens, ok = RL.bucket_step(tokens, last, t, lim)
            prev[k] = (tokens, t)
            plain.append((ok, tokens))
        assert list(zip(got, left)) == plain


def test_limit_zero_refuses_in_batch(spark):
    df = spark.createDataFrame([(1, "a", 0, 0), (2, "b", 0, 3), (3, "b", 6 * SEC, 10)], "request_id long, key_hash string, clock_us long, rate_limit int")
    got = {r.request_id: (r.allowed, r.tokens_after) for r in RL.rate_limit(df, partitions=2).collect()}
    assert got == {1: (False, 0.0), 2: (True, 2.0), 3: (True, 2.0)}


def test_older_request_refills_nothing():
    assert RL.bucket_step(5.0, 100 * SEC, 40 * SEC, 60) == (4.0, True)


def test_replaced_ratio_is_used(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "won double, proposals double")
    for kind, want in (("percent", 50.0), ("per", 0.5)):
        own = with_ratio({}, "r", Ratio("won", "proposals", kind))
        assert df.select(*ratio_columns(own)).first()[0] == want
    assert list(with_ratio(RATIOS, "show_rate", Ratio("won", "proposals"))) == list(RATIOS)
    with pytest.raises(ValueError):
        with_ratio(RATIOS, "x", Ratio("a", "b", "other"))


def test_group_with_empty_first_item_alone_is_left_out(spark):
    items = spark.createDataFrame(
        [("1", "one", "g", 1, [("c", "x")]), ("2", "two", "h", 1, []), ("3", "three", "h", 2, [("c", "y")])],
        "id string, name string, group_id string, pos int, column_values array<struct<id:string,text:string>>")
    assert [(r.item_id, r.c) for r in T.items_to_wide(items).collect()] == [("1", "x")]


def test_first_per_key_keeps_maps(spark):
    df = spark.createDataFrame([("k", 2, {"a": "1"}), ("k", 1, {"b": "2"})], "key string, pos int, place map<string,string>")
    assert J.first_per_key(df, "key", ["pos"]).first().place == {"b": "2"}


def test_cut_pages_are_given_back(spark):
    pages = spark.createDataFrame([("a", 1, None), ("a", 2, "boom"), ("a", 3, None), ("b", 1, None)], "stream string, page int, error string")
    assert sorted((r.stream, r.page) for r in S.prefix_until_error(pages).collect()) == [("a", 1), ("b", 1)]
    assert sorted((r.stream, r.page) for r in S.pages_cut(pages).collect()) == [("a", 2), ("a", 3)]


def test_run_size_is_of_all_its_files(spark):
    import os
    root = tempfile.mkdtemp(prefix="leadflow-runs-")
    df = spark.range(0, 400, numPartitions=4).selectExpr("id AS item_id", "concat('s', id % 3) AS stage")
    path = W.write_grouped_json(df, root, dt.datetime(2024, 1, 1))
    sizes = [os.path.getsize(os.path.join(a, f)) for a, _, fs in os.walk(path) for f in fs if f.endswith(".json")]
    total = sum(sizes)
    r = SN.latest_snapshot(spark, f"{root}/*/run=*").first()
    assert (r.family, r.file_name, r.length) == ("grouped", "run=20240101_000000", total) and r.files == len(sizes) > 1
    assert SN.snapshot_status(spark, f"{root}/*/run=*", ["grouped"]).first().size_kb == round(total / 1024, 2)


def test_empty_part_counts_zero(spark):
    _, doc = W.extraction_manifest({"a": spark.range(3), "none": spark.range(0)}, dt.datetime(2024, 1, 1), tempfile.mkdtemp(prefix="leadflow-man-"))
    r = doc.first()
    assert (r.success, r.summary) == (True, {"a": 3, "none": 0})


def test_late_requests_are_given_back(spark):
    """A request older than the watermark gets no status from the stream."""
    import time

    from leadflow.operators import keys as K
    from leadflow.streaming import requests as ST
    base = tempfile.mkdtemp(prefix="leadflow-late-")
    keys = K.key_registry(spark.createDataFrame([("a", "n", "standard", True, None, 5)], "plain_key string, name string, permission string, is_active boolean, expires_at timestamp, rate_limit int"))
    for part in ([(1, 0, "a"), (2, 100, "a")], [(3, 200, "a"), (4, 5, "nobody")], [(5, 6, "a"), (6, 300, "a")]):
        df = spark.createDataFrame(part, "request_id long, s long, presented_key string")
        df.selectExpr("request_id", "timestamp_seconds(1000 + s) AS ts", "presented_key").coalesce(1).write.mode("append").parquet(f"{base}/log")
        time.sleep(1.1)  # files are taken in the order of their times
    landed = spark.read.parquet(f"{base}/log")
    stream = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/log")
    ST.run_available_now(ST.validate_stream(stream, keys, RL.micros_clock("ts"), watermark="10 seconds"), f"{base}/out", f"{base}/ck", state_partitions=2)
    checked = spark.read.parquet(f"{base}/out")
    assert {r.request_id: r.status for r in checked.collect()} == {1: "ok", 2: "ok", 3: "ok", 4: "invalid", 6: "ok"}
    assert [r.request_id for r in ST.late_requests(landed, checked).collect()] == [5]


def test_cut_distributions_keep_the_most_frequent(spark):
    from leadflow.operators import analytics as A
    df = spark.range(0, 3000).selectExpr("concat('v', cast(sqrt(id) AS int)) AS a", "id % 3 AS b", "cast(null AS string) AS c", "concat('w', cast(sqrt(id) AS int) % 40) AS d")
    got = {}
    for r in A.distributions(df, [("a", "a", 5), ("b", "b", None), ("c", "c", 2), ("d", "d", 7)]).collect():
        got.setdefault(r.dimension, []).append((r.value, r["count"]))
    for name, n in (("a", 5), ("b", 3), ("d", 7)):
        want = sorted(((str(r[0]), r[1]) for r in df.groupBy(name).count().collect()), key=lambda x: (-x[1], x[0]))[:n]
        assert sorted(got[name]) == sorted(want)
    assert "c" not in got


def test_money_sums_are_exact(spark):
    from leadflow.operators import kpi
    df = spark.createDataFrame([(0.1,), (0.2,), (1e16,), (-1e16,), (0.005,)], "x double")
    assert df.agg(kpi.exact_sum(F.col("x"))).first()[0] == 0.305
    assert spark.createDataFrame([(1.0,), (float("inf"),), (1e25,)], "x double").agg(kpi.exact_sum(F.col("x"))).first()[0] == float("inf")
    assert df.limit(0).agg(kpi.exact_sum(F.col("x"))).first()[0] == 0.0

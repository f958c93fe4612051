"""Tables that Spark sizes too low, exploded or read from compressed files, are not broadcast by near-dedup."""

import random
from contextlib import contextmanager

import pytest

from leadflow.llm import components as C
from leadflow.llm import simhash


@contextmanager
def broadcast_limit(spark, size):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def broadcast_rows(df):
    """Rows of each table that the executed plan of ``df`` broadcast."""
    found = []

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            found.append(plan.metrics().apply("numOutputRows").value())
        if kind == "AdaptiveSparkPlanExec":
            walk(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            walk(plan.plan())
        children = plan.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture(scope="module")
def near():
    """4,000 fingerprints in 40 groups: a middle and others one or two bits from it."""
    rnd = random.Random(4)
    groups = []
    for _ in range(40):
        middle, fps = rnd.getrandbits(64), set()
        while len(fps) < 99:
            fps.add(middle ^ (1 << rnd.randrange(64) | 1 << rnd.randrange(64)))
        groups.append([f - (f >> 63 << 64) for f in (middle, *sorted(fps))])
    return groups


def test_dealt_fingerprints_are_not_broadcast(spark):
    rnd = random.Random(1)
    fps = [rnd.getrandbits(64) - (1 << 63) for _ in range(4000)]
    d = spark.createDataFrame([(f, f) for f in fps], "fp long, rep long").distinct()
    with broadcast_limit(spark, "400k"):
        found = simhash.links(d)
        found.collect()
        assert max(broadcast_rows(found), default=0) < 4000


def test_groups_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch, near):
    monkeypatch.setattr(simhash, "FEW", 100, raising=False)
    monkeypatch.setattr(simhash, "fingerprints", lambda d, shingle: d)
    rows = [(f, i * 1000 + j) for i, fps in enumerate(near) for j, f in enumerate(fps)]
    random.Random(2).shuffle(rows)
    d = spark.createDataFrame([(i, f) for f, i in rows], "doc_id long, fp long")
    with broadcast_limit(spark, "64k"):
        out = simhash.simhash_components(d)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in out.collect()}
        assert max(broadcast_rows(out), default=0) <= 40
    assert got == {i: (f"{f % (1 << 64):016x}", i // 1000 * 1000) for f, i in rows}


def test_many_edges_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    rnd = random.Random(3)
    nodes = [rnd.getrandbits(63) for _ in range(20_000)]
    edges = spark.createDataFrame([(n, i % 10) for i, n in enumerate(nodes)], "a long, b long")
    seen = []

    def stored(df, name, keep=C.stored):
        df.collect()
        seen.extend(broadcast_rows(df))
        return keep(df, name)

    monkeypatch.setattr(C, "FEW", 100, raising=False)
    monkeypatch.setattr(C, "stored", stored)
    with broadcast_limit(spark, "400k"):
        got = {r.node: r.component for r in C.components(edges).collect()}
    assert got == {**{n: i % 10 for i, n in enumerate(nodes)}, **{i: i for i in range(10)}}
    assert max(seen, default=0) < 10_000

"""Exact top-k and quantiles against counting and sorting everything."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leadflow.operators import analytics as A
from leadflow.operators import bounded as B


def same_top(df, col, k):
    assert [tuple(r) for r in B.top_values(df, col, k).collect()] == [tuple(r) for r in A.value_counts(df, col, k).collect()]


@pytest.mark.parametrize("kind", ["zipf", "all tied", "few", "one hot", "numbers"])
def test_top_values(spark, kind):
    r = random.Random(len(kind))
    draw = {"zipf": lambda: f"v{int(r.paretovariate(0.7))}", "all tied": None, "few": lambda: r.choice(["a", "b", None]),
            "one hot": lambda: "hot" if r.random() < 0.4 else f"x{r.randrange(5000)}", "numbers": lambda: r.randrange(300)}[kind]
    rows = [(f"t{i % 500}",) for i in range(3000)] if draw is None else [(draw(),) for _ in range(6000)]
    df = spark.createDataFrame(rows, "v long" if kind == "numbers" else "v string").repartition(7)
    for k in (1, 5, 40):
        same_top(df, "v", k)


def test_top_values_edge_cases(spark):
    df = spark.createDataFrame([(None,), (None,)], "v string")
    assert B.top_values(df, "v", 3).count() == 0 and B.top_values(df.limit(0), "v", 3).count() == 0
    same_top(spark.createDataFrame([("é",), ("",), ("",), (None,)], "v string"), "v", 10)


def test_top_values_send_little(spark):
    """A long tail of values of one task each does not leave its task."""
    df = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 10 < 4, F.col("id") % 10).otherwise(F.col("id")).cast("string").alias("value"))
    found, stats = B.top_candidates(df, 4)
    assert stats["tasks"] == 8 and stats["rows_sent"] <= 8 * 5
    assert {r.value for r in found.collect()} == {"0", "1", "2", "3"}
    same_top(df, "value", 4)


@pytest.mark.parametrize("name", ["skewed", "ties", "huge range", "few", "one", "nan", "negative"])
def test_exact_quantiles(spark, name):
    r = random.Random(len(name))
    values = {"skewed": [r.paretovariate(0.3) for _ in range(30_001)], "ties": [float(r.choice([1, 1, 1, 2, 7])) for _ in range(20_000)],
              "huge range": [r.choice([-1, 1]) * 10.0 ** r.randrange(-300, 300) for _ in range(9_998)] + [math.inf, -math.inf], "few": [3.0, 1.0, 2.0, 10.0], "one": [5.5],
              "nan": [1.0, float("nan"), 2.0, None], "negative": [-r.random() for _ in range(12_345)]}[name]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    fractions = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    want = df.agg(F.percentile("x", fractions)).first()[0]
    got = B.exact_quantiles(df, "x", fractions)
    assert [repr(g) for g in got] == [repr(w) for w in want]
    if not any(v is None or v != v for v in values):
        assert B.exact_median(df, "x") == df.agg(F.median("x")).first()[0]


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([(None,)], "x double")
    assert B.exact_quantiles(none, "x", [0.5, 1.0]) == [None, None] and B.exact_median(none.limit(0), F.col("x")) is None
    with pytest.raises(ValueError):
        B.exact_quantiles(none, "x", [1.5])

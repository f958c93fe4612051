"""All reports in one pass, the stored cube and the publication of runs."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from leadflow.operators import cube as C
from leadflow.operators import dashboard as D
from leadflow.operators import kpi as K
from leadflow.session import local_path, scratch_path
from leadflow.sinks import publish as P

AT = dt.datetime(2024, 5, 1, 12)
SCHEMA = ("seq long, stage string, owner string, utm_campaign string, utm_content string, utm_source string, origin string, "
          "date_created string, sales_call_date string, deal_value string")


def some_leads(spark, n=400, seed=3):
    r = random.Random(seed)
    day = lambda: (dt.date(2023, 11, 20) + dt.timedelta(days=r.randrange(200))).isoformat()
    rows = [(i, r.choice(["scheduled", "unqualified", "won", "cancelled", "noshow", "proposal", "lost", "other", None]),
             r.choice(["ann", "bob", "", None, "Total"]), r.choice(["c1", "c2", None]), r.choice(["t1", "t2", "t3", None]),
             r.choice(["google-ads", "linkedin", None]), r.choice(["cold-email", "LinkedIn", None]),
             r.choice([day(), day(), "0201-01-01", "not a date", None]), r.choice([day(), day(), None]),
             r.choice(["10.5", "0.1", "1e3", "n/a", None])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    def text(v):
        return repr(round(v, 9)) if isinstance(v, float) else repr(v)
    return sorted(tuple(map(text, r)) for r in df.collect())


def same_as_direct(leads, board, start, end):
    for report in D.REPORTS:
        if K.spec(report, "utm_source" in leads.columns).key in leads.columns:
            direct = K.kpi_report(leads, report, start, end)
            one = D.report_of(board, report)
            assert one.columns == direct.columns
            assert rows(one) == rows(direct), report


def test_dashboard_equals_the_six_reports(spark):
    leads = some_leads(spark)
    same_as_direct(leads, D.dashboard(leads, "2024-01-05", "2024-03-31").persist(), "2024-01-05", "2024-03-31")


@pytest.mark.parametrize("case", ["empty", "null owners", "no dates in range", "no campaigns of the channel", "huge amounts"])
def test_dashboard_edge_cases(spark, case):
    leads = some_leads(spark, 60)
    if case == "empty":
        leads = leads.limit(0)
    if case == "null owners":
        leads = leads.withColumn("owner", F.lit(None).cast("string"))
    if case == "no campaigns of the channel":
        leads = leads.withColumn("utm_source", F.lit("linkedin"))
    if case == "huge amounts":
        leads = leads.withColumn("deal_value", F.when(F.col("seq") % 3 == 0, "1e22").otherwise(F.col("deal_value")))
    start, end = ("2030-01-01", "2030-02-01") if case == "no dates in range" else ("2023-12-01", "2024-02-29")
    same_as_direct(leads, D.dashboard(leads, start, end), start, end)


def test_dashboard_missing_columns(spark):
    leads = some_leads(spark, 80).drop("utm_content", "utm_source", "deal_value", "sales_call_date", "origin")
    board = D.dashboard(leads, "2024-01-01", "2024-03-01", reports=("overview", "by_campaign", "by_content"))
    assert {r.report for r in board.select("report").collect()} == {"overview", "by_campaign"}
    direct = K.kpi_report(leads, "by_campaign", "2024-01-01", "2024-03-01")
    assert rows(D.report_of(board, "by_campaign")) == rows(direct)
    with pytest.raises(ValueError):
        D.dashboard(leads.drop("owner", "utm_campaign"), "2024-01-01", "2024-03-01")


def test_dashboard_reads_leads_once(spark):
    path = scratch_path(spark, "leads")
    some_leads(spark).write.parquet(path)
    board = D.dashboard(spark.read.parquet(path), "2024-01-05", "2024-03-31")
    plan = board._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert plan.count("Exchange hashpartitioning") == 2     # by key, and of one row a report and key


def cube_of(spark, parts):
    root = scratch_path(spark, "cube")
    for i, p in enumerate(parts):
        C.add_run(p, root, f"run-{i}", AT + dt.timedelta(hours=4 * i))
    return root


def test_cube_equals_direct_reports_for_random_ranges(spark):
    leads = some_leads(spark, 600).cache()
    root = cube_of(spark, [leads.filter(F.col("seq") % 3 == i) for i in range(3)])
    r = random.Random(5)
    ranges = [sorted((dt.date(2023, 11, 1) + dt.timedelta(days=r.randrange(260))) for _ in range(2)) for _ in range(5)]
    ranges += [(dt.date(2024, 1, 1), dt.date(2024, 1, 31)), (dt.date(200, 1, 1), dt.date(2100, 1, 1)),
               (dt.date(2024, 2, 3), dt.date(2024, 2, 3)), (dt.date(2024, 3, 1), dt.date(2024, 2, 1))]
    for start, end in ranges:
        assert rows(C.cube_dashboard(spark, root, start, end)) == rows(D.dashboard(leads, start, end)), (start, end)
    # A compaction answers the same and replaces the runs; their files stay as they were.
    before = rows(C.cube_dashboard(spark, root, "2024-01-10", "2024-04-02"))
    C.compact(spark, root, ["run-0", "run-1"], "merged", AT + dt.timedelta(days=2))
    assert P.live_runs(spark, root) == ["run-2", "merged"]
    assert rows(C.cube_dashboard(spark, root, "2024-01-10", "2024-04-02")) == before
    assert P.unfinished(spark, root, "run-0") == {}


def test_cube_new_run_adds_rows_only_and_reads_two_months_a_run(spark):
    leads = some_leads(spark, 500)
    root = cube_of(spark, [leads.filter("seq < 250")])

    def files():
        return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(local_path(root)) for f in fs}
    before = files()
    C.add_run(leads.filter("seq >= 250"), root, "second", AT + dt.timedelta(hours=4))
    after = files()
    assert {k: after[k] for k in before} == before and len(after) > len(before)
    cube = C.range_metrics(spark, root, "2023-12-10", "2024-05-05")
    months = {f.split("month=")[1][:7] for f in cube.inputFiles() if "/facts/" in f}
    assert months == {"2023-12", "2024-05"}
    with pytest.raises(ValueError):
        C.add_run(leads, root, "second", AT)


def test_cube_wide_amounts_and_no_runs(spark):
    leads = some_leads(spark, 120).withColumn("deal_value", F.when(F.col("seq") % 5 == 0, "1e25").when(F.col("seq") % 7 == 0, "inf").otherwise("2.25"))
    root = cube_of(spark, [leads.filter("seq < 60"), leads.filter("seq >= 60")])
    for start, end in (("2024-01-01", "2024-02-10"), ("2023-11-01", "2024-07-01")):
        assert rows(C.cube_dashboard(spark, root, start, end)) == rows(D.dashboard(leads, start, end))
    nothing = scratch_path(spark, "cube-empty")
    assert rows(C.cube_dashboard(spark, nothing, "2024-01-01", "2024-02-10")) == rows(D.dashboard(leads.limit(0), "2024-01-01", "2024-02-10"))


def test_publication_is_whole_or_absent(spark):
    root = scratch_path(spark, "published")
    df = spark.range(10)
    P.publish(spark, root, "one", {"a": lambda p: df.write.parquet(p), "b": lambda p: df.write.json(p)}, AT)

    def dies(path):
        df.write.parquet(path)                      # a dataset is written in full, then the job dies
        raise RuntimeError("killed")
    with pytest.raises(RuntimeError):
        P.publish(spark, root, "two", {"a": dies, "b": lambda p: df.write.json(p)}, AT + dt.timedelta(hours=1))
    assert os.path.isdir(local_path(f"{P.run_folder(root, 'two')}/a"))
    assert P.live_runs(spark, root) == ["one"] and P.latest_run(spark, root) == "one"
    assert spark.read.parquet(f"{P.run_folder(root, P.latest_run(spark, root))}/a").count() == 10
    P.publish(spark, root, "three", {"a": lambda p: df.write.parquet(p)}, AT + dt.timedelta(hours=2), replaces=["one"])
    assert P.live_runs(spark, root) == ["three"]
    with pytest.raises(ValueError):
        P.publish(spark, root, "three", {}, AT)
    with pytest.raises(ValueError):
        P.publish(spark, root, "../up", {}, AT)
    with pytest.raises(FileNotFoundError):
        P.latest_run(spark, scratch_path(spark, "nothing"))
    assert P.unfinished(spark, root, "three") == {}

"""A stored cube of lead metrics that answers any date range without reading leads.

A refresh adds one run (:func:`add_run`): its leads are counted by (key column, key, stage,
clock, date), where the clock says which of a lead's two dates counts it (``c`` created, ``s`` sales
call). Money is summed as decimals, so sums and differences are exact. A run is published as a
whole (:mod:`leadflow.sinks.publish`) and later runs only add rows; :func:`compact` puts several runs
into one.

Prefix sums: a run's facts are partitioned by month, and the folder of a month holds, beside
its daily rows, one *opening* row per group with the sums of everything before that
month. The sums up to a day are then the opening rows of one month and some of its daily
rows, and a range is the difference of two of those: whatever its length, at most two
month folders a run are read. Only months that have facts get a folder (a mistyped year adds one
folder, not centuries of them).

Three datasets a run: ``facts`` as above; ``keys``, the leads of every key in all, dated or
not (reports show keys without a lead in range too); ``wide``, daily sums of amounts that no decimal
holds (infinities, 1e19 and over), which are added up day by day.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadflow.functions.columns import _as_date, coerce_date
from leadflow.functions.metrics import RATIOS, Ratio
from leadflow.operators import dashboard as D
from leadflow.schemas import BOOKED_STAGES, PROPOSAL_STAGES, TAKEN_STAGES
from leadflow.sinks.publish import commits, live_runs, publish, run_folder

GROUP = ("dim", "key", "stage", "clock")
MEASURES = ("n", "channel", "cold", "linkedin", "google", "amount")
FACTS = ("dim string, key string, stage string, clock string, date date, opening boolean, n long, channel long, "
         "cold long, linkedin long, google long, amount decimal(38,9), month string")
KEYS = "dim string, key string, rows long, channel_rows long"
WIDE = "dim string, key string, stage string, clock string, date date, wide double"
MONTHS = "month string"


def daily_facts(leads: DataFrame, date_col: str = "date_created", sales_date_col: str | None = "sales_call_date") -> DataFrame:
    """``(*GROUP, date, *MEASURES, wide)``: leads counted per group and day; undated
    leads under a null date. One scan and one shuffle of partial aggregates."""
    keys, flags = D.present_keys(leads), D.lead_flags(leads)
    sales = sales_date_col if sales_date_col in leads.columns else date_col
    amount = D.lead_amount(leads)
    exact = amount.try_cast("decimal(28,9)")

    def created(name: str) -> Column:
        return coerce_date(name) if name in leads.columns else F.lit(None).cast("date")

    rows = (leads.filter(F.col("stage").isin(*BOOKED_STAGES))
            .select(*keys, "stage", *[f.alias(f"_{n}") for n, f in flags.items()], exact.alias("_exact"),
                    F.when(exact.isNull(), amount).alias("_wide"),
                    F.inline(F.array(F.struct(F.lit("c").alias("clock"), created(date_col).alias("date")),
                                     F.struct(F.lit("s").alias("clock"), created(sales).alias("date"))))))
    rest = ["stage", "clock", "date"]
    every = (1 << len(keys)) - 1
    per = (rows.groupingSets([[F.col(k), *map(F.col, rest)] for k in keys], *keys, *rest)
           .agg(F.grouping_id(*keys, *rest).alias("_set"), F.count(F.lit(1)).alias("n"),
                *[F.count_if(F.col(f"_{n}")).alias(n) for n in ("channel", "cold", "linkedin", "google")],
                F.coalesce(F.sum("_exact"), F.lit(0)).cast("decimal(38,9)").alias("amount"), F.sum("_wide").alias("wide")))
    dim, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        here = F.col("_set") == ((every ^ (1 << (len(keys) - 1 - i))) << len(rest))
        dim, key = F.when(here, k).otherwise(dim), F.when(here, F.col(k).cast("string")).otherwise(key)
    return (per.select(dim.alias("dim"), key.alias("key"), *rest, *MEASURES, "wide").filter(F.col("key").isNotNull()))


def with_openings(days: DataFrame, months: Sequence[str]) -> DataFrame:
    """The daily rows and, for each of ``months`` after a group's first, its opening row. A
    group's window has a row per month, not per lead."""
    month = F.date_format("date", "yyyy-MM")
    days = days.select(*GROUP, "date", F.lit(False).alias("opening"), *MEASURES, month.alias("month"))
    group = Window.partitionBy(*GROUP).orderBy("month")
    upto = group.rowsBetween(Window.unboundedPreceding, 0)
    per_month = days.groupBy(*GROUP, "month").agg(*[F.sum(m).alias(m) for m in MEASURES])
    sums = per_month.select(*GROUP, "month", F.lead("month").over(group).alias("_next"),
                            *[F.sum(m).over(upto).cast("decimal(38,9)" if m == "amount" else "long").alias(m) for m in MEASURES])
    later = F.filter(F.array(*[F.lit(m) for m in months]).cast("array<string>"),
                     lambda m: (m > F.col("month")) & (F.col("_next").isNull() | (m <= F.col("_next"))))
    opening = sums.select(*GROUP, F.lit(None).cast("date").alias("date"), F.lit(True).alias("opening"), *MEASURES, F.explode(later).alias("month"))
    return days.withColumn("amount", F.col("amount").cast("decimal(38,9)")).unionByName(opening)


def _write_run(spark: SparkSession, root: str, run: str, facts: DataFrame, keys: DataFrame, wide: DataFrame,
               at: _dt.datetime, replaces: Sequence[str] = ()) -> str:
    """``facts``: stored daily rows with a date. Its months (a few hundred at most for real dates) are
    needed as a list, to open them for every group."""
    months = sorted(r.month for r in facts.select(F.date_format("date", "yyyy-MM").alias("month")).distinct().collect())
    parts = with_openings(facts, months).hint("rebalance", F.col("month"))
    return publish(spark, root, run, {
        "facts": lambda path: parts.write.partitionBy("month").parquet(path),
        "keys": lambda path: keys.write.parquet(path),
        "wide": lambda path: wide.write.parquet(path),
        "months": lambda path: spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in months]).cast("array<string>")).alias("month")).write.parquet(path),
    }, at, replaces)


def add_run(leads: DataFrame, root: str, run: str, at: _dt.datetime, date_col: str = "date_created",
            sales_date_col: str | None = "sales_call_date") -> str:
    """Publishes the metrics of new ``leads`` as run ``run``; earlier runs stay untouched."""
    spark = leads.sparkSession
    days = daily_facts(leads, date_col, sales_date_col).checkpoint()     # several tables are made of it
    keys = days.filter("clock = 'c'").groupBy("dim", "key").agg(F.sum("n").alias("rows"), F.sum("channel").alias("channel_rows"))
    return _write_run(spark, root, run, days.filter("date IS NOT NULL").drop("wide"), keys,
                      days.filter("date IS NOT NULL AND wide IS NOT NULL").select(*GROUP, "date", "wide"), at)


def _read(spark: SparkSession, root: str, runs: Sequence[str], dataset: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{run_folder(root, r)}/{dataset}" for r in runs])


def compact(spark: SparkSession, root: str, runs: Sequence[str], into: str, at: _dt.datetime) -> str:
    """Publishes one run holding what ``runs`` hold, and replacing them for readers."""
    days = reduce(DataFrame.unionByName, [_read(spark, root, [r], "facts", FACTS) for r in runs])
    days = (days.filter("NOT opening").groupBy(*GROUP, "date").agg(*[F.sum(m).alias(m) for m in MEASURES])
            .withColumn("amount", F.col("amount").cast("decimal(38,9)")).checkpoint())
    keys = _read(spark, root, runs, "keys", KEYS).groupBy("dim", "key").agg(F.sum("rows").alias("rows"), F.sum("channel_rows").alias("channel_rows"))
    wide = _read(spark, root, runs, "wide", WIDE).groupBy(*GROUP, "date").agg(F.sum("wide").alias("wide"))
    return _write_run(spark, root, into, days, keys, wide, at, replaces=list(runs))


def _day(day: _dt.date) -> Column:
    """A date literal of any year (those before 1000 have no literal of their own)."""
    return F.date_from_unix_date(F.lit((day - _dt.date(1970, 1, 1)).days))


def _month_of(months: Sequence[str], day: _dt.date) -> str | None:
    """The last of ``months`` that begins by ``day``."""
    reached = [m for m in months if m <= f"{day.year:04d}-{day.month:02d}"]
    return max(reached, default=None)


def range_metrics(spark: SparkSession, root: str, start, end) -> DataFrame:
    """``(dim, key, *COUNTS, *AMOUNTS)`` as :func:`dashboard.shared_metrics` gives them for leads dated
    ``start`` to ``end``, from the published runs alone; one shuffle of cube rows."""
    runs = live_runs(spark, root)
    start, end = _as_date(start), _as_date(end)
    blank = {**{m: F.lit(0).cast("decimal(38,9)" if m == "amount" else "long") for m in MEASURES},
             "wide": F.lit(None).cast("double"), "rows": F.lit(0).cast("long"), "channel_rows": F.lit(0).cast("long")}

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        stage = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("stage", "clock")]
        return df.select("dim", "key", *stage, *[given.get(c, blank[c]).alias(c) for c in blank])

    if not runs:
        keys = spark.createDataFrame([], KEYS)
        parts = [rows(keys)]
    else:
        parts = [rows(_read(spark, root, runs, "keys", KEYS), rows=F.col("rows"), channel_rows=F.col("channel_rows"))]
    if runs and start <= end:
        with_run = spark.read.schema(MONTHS).parquet(*[f"{run_folder(root, r)}/months" for r in runs])
        name = F.regexp_extract(F.input_file_name(), r"/runs/([^/]+)/months/", 1)
        months = {r.run: r.m for r in with_run.groupBy(name.alias("run")).agg(F.collect_list("month").alias("m")).collect()}
        for day, sign in ((end, 1), (start - _dt.timedelta(days=1), -1)):
            last = {r: _month_of(ms, day) for r, ms in months.items()}
            folders = [f"{run_folder(root, r)}/facts/month={m}" for r, m in sorted(last.items()) if m]
            if folders:
                facts = spark.read.schema(FACTS).parquet(*folders).filter(F.col("opening") | (F.col("date") <= _day(day)))
                parts.append(rows(facts, **{m: F.col(m) * sign for m in MEASURES}))
        wide = _read(spark, root, runs, "wide", WIDE).filter(F.col("date").between(_day(start), _day(end)))
        parts.append(rows(wide, wide=F.col("wide")))
    every = reduce(DataFrame.unionByName, [p.withColumn("amount", F.col("amount").cast("decimal(38,9)")) for p in parts])

    c, s, stage = F.col("clock") == "c", F.col("clock") == "s", F.col("stage")

    def total(measure: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(measure))), F.lit(0))

    taken, proposals = stage.isin(*TAKEN_STAGES), stage.isin(*PROPOSAL_STAGES)
    out = {"booked": total("n", c), "booked_channel": total("channel", c), "taken_c": total("n", c & taken), "taken_s": total("n", s & taken),
           "unqualified_c": total("n", c & (stage == "unqualified")), "unqualified_s": total("n", s & (stage == "unqualified")),
           "cancelled": total("n", c & (stage == "cancelled")), "proposals": total("n", s & proposals), "won": total("n", s & (stage == "won")),
           "cold": total("cold", c), "linkedin": total("linkedin", c), "google": total("google", c),
           "rows": F.sum("rows"), "channel_rows": F.sum("channel_rows")}
    for name, of in (("won_amount", "won"), ("proposal_amount", "proposal")):
        here = c & (stage == of)
        out[name] = total("amount", here).cast("double") + F.coalesce(F.sum(F.when(here, F.col("wide"))), F.lit(0.0))
    return every.groupBy("dim", "key").agg(*[e.alias(n) for n, e in out.items()])


def cube_dashboard(spark: SparkSession, root: str, start, end, reports: Sequence[str] = D.REPORTS,
                   metrics: Mapping[str, Ratio] = RATIOS, total: bool = True) -> DataFrame:
    """The dashboard of :func:`dashboard.dashboard` for any date range, from the cube."""
    return D.assemble(range_metrics(spark, root, start, end), reports, metrics, total)


def cube_size(spark: SparkSession, root: str) -> DataFrame:
    """(run, dataset, files, bytes) of the live runs."""
    return commits(spark, root).filter(F.col("run").isin(*live_runs(spark, root))).select("run", "dataset", "files", "bytes")

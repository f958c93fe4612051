"""Exact top-k and exact quantiles whose shuffles and buffers do not grow with the number of
distinct values.

:func:`top_values`, a three-phase threshold algorithm over the tasks' own counts:

1. Each task sends its k most frequent values. Their sums are lower bounds of the totals, so the
   k-th largest of them, T, is a lower bound of the k-th largest total.
2. Each task sends the values it holds at least T / tasks times. A value that no task sends has a total
   below T; of the others, those whose upper bound reaches the k-th best lower bound are candidates.
3. The candidates are recounted exactly.

:func:`exact_quantiles`, distributed selection: a quantile sketch of bounded size gives two pivots that
are likely to enclose the wanted rank, exact counts tell on which side of them it lies, and the
search goes on inside. Each round leaves a few ten-thousandths of the rows; equal values end it
at once. The result is exact for any data; only the number of rounds depends on it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates are broadcast up to this number (a few MB), joined beyond it.
MAX_BROADCAST_VALUES = 100_000
#: A task's counts are merged when so many partial counts have gathered.
MERGE_ROWS = 1 << 18
#: Accuracy of the sketch that proposes pivots.
ACCURACY = 10_000


def _task_counts(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """(value, count) of all rows of a task."""
    held: list[pa.Table] = []
    rows = 0

    def merged() -> pa.Table:
        t = pa.concat_tables(held).group_by("value").aggregate([("count", "sum")])
        return t.rename_columns(["value", "count"]) if t.column_names[0] == "value" else t.select(["value", "count_sum"]).rename_columns(["value", "count"])

    for b in batches:
        if b.num_rows:
            c = pc.value_counts(b.column(0))
            held.append(pa.table({"value": c.field("values"), "count": c.field("counts")}))
            rows += len(c)
            if rows > MERGE_ROWS:
                held = [merged()]
                rows = 0
    return merged() if held else None


def _sent(values: DataFrame, k: int | None, least: int) -> DataFrame:
    """What the tasks send: (value, count) of their ``k`` most frequent values, or of those they hold
    ``least`` times; and a row (null, 1) of each task that holds any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _task_counts(batches)
        if counts is None:
            return
        if k is not None:
            counts = counts.sort_by([("count", "descending")]).slice(0, k)
        counts = counts.filter(pc.greater_equal(counts["count"], least))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, counts.schema.field("value").type), pa.array([1], pa.int64())], ["value", "count"])
        yield from counts.combine_chunks().cast(pa.schema([counts.schema.field("value"), ("count", pa.int64())])).to_batches()

    return values.mapInArrow(run, values.select("value").schema.add("count", "long"))


def _kth(lower: DataFrame, k: int) -> int:
    """The k-th largest lower bound, 0 if there are fewer."""
    best = lower.filter(F.col("value").isNotNull()).orderBy(F.col("low").desc()).limit(k).collect()
    return best[-1].low if len(best) == k else 0


def top_candidates(values: DataFrame, k: int) -> tuple[DataFrame, dict[str, int]]:
    """Phases 1 and 2 over the non-null column ``value``: the values that can be among the ``k`` most
    frequent, and what was found on the way."""
    first = _sent(values, k, 1).groupBy("value").agg(F.sum("count").alias("low")).checkpoint()
    bound = _kth(first, k)
    tasks = sum(r.low for r in first.filter(F.col("value").isNull()).collect())
    while True:
        least = max(1, -(-bound // max(1, tasks)))
        second = _sent(values, None, least).groupBy("value").agg(F.sum("count").alias("low"), F.count(F.lit(1)).alias("senders")).checkpoint()
        seen = sum(r.low for r in second.filter(F.col("value").isNull()).collect())
        if seen <= tasks or least == 1:
            break
        tasks = seen                    # the rows were dealt to more tasks this time
    best = max(bound, _kth(second, k))
    high = F.col("low") + (F.lit(seen) - F.col("senders")) * (least - 1)
    found = second.filter(F.col("value").isNotNull() & (high >= best)).select("value")
    return found, {"tasks": seen, "bound": best, "least": least, "rows_sent": second.count()}


def top_values(df: DataFrame, col: str, k: int, value_name: str = "value") -> DataFrame:
    """The ``k`` most frequent non-null values with their counts, count desc then value asc: the rows of
    ``value_counts(df, col, k)``. Reads ``df`` three times; store one that is costly."""
    values = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("value"))
    found, _ = top_candidates(values, k)
    small = found.limit(MAX_BROADCAST_VALUES + 1).count() <= MAX_BROADCAST_VALUES
    exact = (values.join(F.broadcast(found) if small else found, "value", "left_semi")
             .groupBy("value").agg(F.count(F.lit(1)).alias("count")))
    return exact.orderBy(F.col("count").desc(), F.col("value").asc()).limit(k).withColumnRenamed("value", value_name)


def _select(rows: DataFrame, rank: int, n: int) -> float:
    """The value at 0-based ``rank`` of the ``n`` values of column ``x``."""
    inside: Column = F.lit(True)
    below = 0                           # rows before those inside
    while True:
        here = rows.filter(inside)
        at = (rank - below + 0.5) / n
        near = [min(1.0, max(0.0, at + d)) for d in (-1.5 / ACCURACY, 0.0, 1.5 / ACCURACY)]
        pivots = sorted(set(here.agg(F.percentile_approx("x", near, ACCURACY)).first()[0]))
        counts = here.agg(*[c for p in pivots for c in (F.count_if(F.col("x") < p), F.count_if(F.col("x") <= p))]).first()
        low, high, first, last = None, None, below, below + n
        for i, p in enumerate(pivots):
            before, upto = below + counts[2 * i], below + counts[2 * i + 1]
            if before <= rank < upto:
                return p
            if upto <= rank:
                low, first = p, upto
            elif high is None:
                high, last = p, before
        if low is not None:
            inside = inside & (F.col("x") > low)
        if high is not None:
            inside = inside & (F.col("x") < high)
        below, n = first, last - first


def exact_quantiles(df: DataFrame, col: str | Column, fractions: Sequence[float]) -> list[float | None]:
    """Exact quantiles of the non-null numbers of a column, between two neighbours as linear
    interpolation (as ``percentile`` does); None without numbers. NaN counts as the largest. Runs
    jobs; store a costly ``df``."""
    x = F.col(col) if isinstance(col, str) else col
    rows = df.select(x.cast("double").alias("x")).filter(F.col("x").isNotNull())
    n, nan = rows.agg(F.count(F.lit(1)), F.count_if(F.isnan("x"))).first()
    numbers, m = rows.filter(~F.isnan("x")), n - nan

    def value(rank: int) -> float:
        return _select(numbers, rank, m) if rank < m else float("nan")

    out: list[float | None] = []
    for f in fractions:
        if not 0 <= f <= 1:
            raise ValueError(f"fraction {f} is not between 0 and 1")
        if not n:
            out.append(None)
            continue
        place = f * (n - 1)
        low = int(place)
        a = value(low)
        if place == low:
            out.append(a)
            continue
        b = a
        if numbers.filter(F.col("x") <= a).count() <= low + 1:
            b = numbers.filter(F.col("x") > a).agg(F.min("x")).first()[0]
            b = float("nan") if b is None else b
        out.append(a if a == b else (low + 1 - place) * a + (place - low) * b)
    return out


def exact_median(df: DataFrame, col: str | Column) -> float | None:
    return exact_quantiles(df, col, [0.5])[0]

"""Quality rules (operator 7) with adaptive thresholds.

Per document the features are exact counts. Instead of fixed cutoffs, the fences
come from quantile sketches per (language, source): each feature is a ratio in
1/1000, and a sketch counts the documents per logarithmic bucket of its value, each
``GAMMA`` times as wide as the one before. So a quantile is right to one per cent, a
sketch has at most some two thousand buckets however many documents and values there are, and
sketches merge by addition, in any order, with the same result. The fences are
joined back to the documents and filter them.

Edge cases: a null or empty text has no words and fails the base rules; null
languages and sources form their own groups (null-safe join); a fence is the mean, by
documents, of the language's own and that of all documents counted as ``min_group``, and
a group's likewise of its own and its language's, never wider than its language's, so a
source that is mostly junk does not raise it; repeated rows are judged alike;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.llm.common import slices, stored, with_text, words

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios in 1/1000 and the least width of their fence, in the same unit: it keeps
#: groups whose middle half is one value from rejecting every slight departure.
RATIOS = {"word_len": 500, "symbols": 100, "dup_lines": 200, "repeats": 100}
#: Ratio of neighbouring bucket bounds in a sketch: quantiles are within 1 %.
GAMMA = 1.02
#: Fences of at most this many groups are broadcast; more are joined by a shuffle.
MAX_BROADCAST_GROUPS = 50_000
#: Ratios whose low side is suspicious too.
TWO_SIDED = {"word_len"}


def features(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    w = words(text)
    n = len(w)
    blanks = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = Counter(text.split("\n"))
    dup = sum(c - 1 for line, c in lines.items() if c > 1 and words(line))
    repeat = 0
    if n >= 4:
        windows = list(zip(w, w[1:], w[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            twice = np.fromiter((counts[x] > 1 for x in windows), bool, n - 2)
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k:n - 2 + k] |= twice
            repeat = int(cover.sum())
    return n, len(text) - blanks, symbols, dup, repeat


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, then the five counts of ``BASE``, then n_lines (lines with a word)."""
    src, at = with_text(docs, keep)
    out = docs.select(*keep).schema.simpleString()[len("struct<"):-1].replace(":", " ")
    schema = f"{out}, " + ", ".join(f"{c} long" for c in [*BASE, "n_lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for b in batches for p in slices(b)):
            rows = []
            for t in b.column(at):
                t = t.as_py()
                rows.append((*features(t), sum(1 for x in t.split("\n") if words(x)) if t else 0))
            counts = np.array(rows, np.int64).reshape(-1, len(BASE) + 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *map(pa.array, counts.T)], [*keep, *BASE, "n_lines"])

    return src.mapInArrow(run, schema)


def _ratios(df: DataFrame) -> DataFrame:
    def ratio(a: str, b: str) -> F.Column:
        return F.expr(f"({a} * 1000) div greatest({b}, 1L)")

    return df.withColumns({"word_len": ratio("word_chars", "n_words"), "symbols": ratio("n_symbols", "n_words"),
                           "dup_lines": ratio("n_dup_lines", "n_lines"), "repeats": ratio("n_repeat_words", "n_words")})


def bucket_of(value: Column) -> Column:
    """Number of the logarithmic bucket of a whole number; zero has one of its own, -1."""
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(math.log(GAMMA)))).otherwise(F.lit(-1)).cast("int")


def value_of(bucket: Column) -> Column:
    """The value in a bucket's middle: within 1 % of every value in it."""
    return F.when(bucket >= 0, F.pow(F.lit(GAMMA), bucket) * (2 / (GAMMA + 1))).otherwise(F.lit(0.0))


def quantile_sketch(df: DataFrame, by: list[str]) -> DataFrame:
    """(*by, ratio, bucket, n): the merged sketch of each ratio, one row per bucket."""
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), bucket_of(F.col(r)).alias("bucket")) for r in RATIOS]))
    return df.select(*by, rows.alias("x")).groupBy(*by, "x.ratio", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, by: list[str], spread: float) -> DataFrame:
    """(*by, n, low_<ratio>, high_<ratio>): Tukey fences, ``spread`` times the middle
    half (at least the least width) beyond the quartiles read off the sketch. Where the
    middle half is one value, the stretch from it to the outer tenth takes its place."""
    w = Window.partitionBy(*by, "ratio")
    at = sketch.select("*", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("total"))
    q = at.groupBy(*by, "ratio").agg(F.max("total").alias("n"), *[
        value_of(F.min(F.when(F.expr(f"upto * 20 >= total * {k}"), F.col("bucket")))).alias(name)
        for name, k in (("d1", 2), ("q1", 5), ("q3", 15), ("d9", 18))])
    out = []
    for r, width in RATIOS.items():
        def reach(tail: Column) -> Column:
            half = F.col("q3") - F.col("q1")
            return F.greatest(F.when(half > 0, half).otherwise(tail) * F.lit(spread), F.lit(float(width)))

        mine = F.col("ratio") == r
        out += [F.max(F.when(mine, F.col("q3") + reach(F.col("d9") - F.col("q3")))).alias(f"high_{r}")]
        if r in TWO_SIDED:
            out += [F.max(F.when(mine, F.col("q1") - reach(F.col("q1") - F.col("d1")))).alias(f"low_{r}")]
    return q.groupBy(*by).agg(F.max("n").alias("n"), *out)


def quality_rules(docs: DataFrame, keep: list[str] | None = None, spread: float = 4.0, min_group: int = 200) -> DataFrame:
    """``keep`` (default doc_id, lang, source) with the counts of ``BASE``, base_failed and kept.

    base_failed: fewer than 50 words, or over half of them in repeated windows.
    The fences learn from the documents that pass the base rules.
    """
    keep = keep or ["doc_id", "lang", "source"]
    keep = list(dict.fromkeys([*keep, "lang", "source"]))
    base = stored(_ratios(with_features(docs, keep)).withColumn(
        "base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")), "quality")
    fine = stored(quantile_sketch(base.filter("not base_failed"), ["lang", "source"]), "sketch")
    by_lang = fine.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n"))
    by_all = fine.groupBy("ratio", "bucket").agg(F.sum("n").alias("n"))
    names = [f"high_{r}" for r in RATIOS] + [f"low_{r}" for r in sorted(TWO_SIDED)]

    def level(sk: DataFrame, by: list[str], tag: str) -> DataFrame:
        f = fences(sk, by, spread)
        return f.select(*[F.col(c).alias(f"{tag}_{c}") for c in by], F.struct(*names).alias(f"{tag}"), F.col("n").alias(f"{tag}_n"))

    own = level(fine, ["lang", "source"], "g")
    lang = level(by_lang, ["lang"], "l")
    # The fence of all documents is one row of fixed size: written into the plan.
    whole = fences(by_all.withColumn("one", F.lit(1)), ["one"], spread).first()

    def blend(tag: str, c: str, wider: Column) -> Column:
        """The level's own value and the wider level's, which counts as ``min_group`` documents."""
        mean = (F.col(f"{tag}_n") * F.col(f"{tag}.{c}") + F.lit(min_group) * wider) / (F.col(f"{tag}_n") + F.lit(min_group))
        return F.coalesce(mean, wider)

    def fence(c: str) -> Column:
        of_lang = blend("l", c, F.lit(whole[c] if whole else None).cast("double"))
        return (F.least if c.startswith("high") else F.greatest)(blend("g", c, of_lang), of_lang).alias(c)

    # One fence row per (lang, source) seen, joined null-safe to the documents.
    groups = (base.select("lang", "source").distinct()
              .join(own, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
              .join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
              .select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), F.struct(*map(fence, names)).alias("fence")))
    groups = stored(groups, "fences")
    few = groups.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS
    judged = base.join(F.broadcast(groups) if few else groups, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    inside = F.lit(True)
    for r in RATIOS:
        inside = inside & (F.col(r) <= F.col(f"fence.high_{r}"))
    for r in TWO_SIDED:
        inside = inside & (F.col(r) >= F.col(f"fence.low_{r}"))
    return judged.select(*keep, *BASE, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))

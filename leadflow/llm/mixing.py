"""Mixing sources to target weights (operator 6) by Pareto order sampling.

Sources, in code point order with null last, weigh ``weights`` in turn and share the
total size; a target stops at ``max_repeats`` times its source's size and the excess is
reshared by weight. Within a source a document's expected copies are its share of the
target, in proportion to a document weight that rises with the document's size (by classes, each
twice as long as the one before: :func:`class_weight`), so inclusion odds are unequal. The whole part of the expected copies is taken
for certain. For the fraction p, documents are ranked by the Pareto ratio
(u / (1 - u)) / (p / (1 - p)), u being a fixed hash of the id and text, and taken in that order up
to the words still missing (the last one if that comes nearer), so a source's sample
has a fixed size in words.

The running sum is taken in two steps, over bins of the ranking and within the one bin
where it ends, so no task sorts a whole source.

Edge cases: a null text has size 0 and is taken in rank order like any other, which
adds no words; a source of size 0 has target 0; rows of equal (or null) ids spread over
the ranking by their texts, and only rows equal in both are ties; all-empty tables give
targets 0; an empty table gives an empty result; further columns are kept out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadflow.llm.common import stored

WEIGHTS = (5, 2, 1)
BINS = 4096
#: The plan, one row a source, is broadcast up to this many sources.
MAX_BROADCAST_SOURCES = 100_000


def word_count(text: str) -> F.Column:
    """Number of `[^\\x20\\x09-\\x0D]+` of a column; null: 0."""
    return F.coalesce(F.expr(f"regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS,
            max_repeats: int = 3) -> dict[str | None, float]:
    """Target of each source from (source, size)."""
    ordered = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    cap = {s: max_repeats * n for s, n in ordered}
    left, open_ = float(sum(n for _, n in ordered)), [s for s, _ in ordered]
    out: dict[str | None, float] = {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > cap[s]]
        if not full:
            out.update({s: left * weight[s] / total for s in open_})
            break
        out.update({s: float(cap[s]) for s in full})
        left -= sum(cap[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def size_class(size: str) -> F.Column:
    """0 for no word, 1 for one, 2 for two or three, and so on."""
    return F.length(F.expr(f"trim(LEADING '0' FROM bin({size}))")).cast("int")


def class_weight(c):
    """Weight of a size class: a quarter for an empty document, 1 from 2,048 words on."""
    return (4 + c) / 16


def rate_of(target: float, sizes: dict[int, int], max_repeats: int) -> float:
    """Expected copies of a document of weight 1, so that the expected words of a source with
    ``sizes`` words by class meet the target, no document getting more than ``max_repeats`` copies."""
    words = sorted(((min(1.0, class_weight(c)), n) for c, n in sizes.items() if n), reverse=True)
    full = 0                                # words of the classes that get max_repeats
    for k, (w, n) in enumerate(words):
        rate = (target - max_repeats * full) / sum(v * m for v, m in words[k:])
        if rate * w <= max_repeats:
            return rate
        full += n
    return max_repeats / words[-1][0] if words else 0.0


def mix(docs: DataFrame, keep: list[str] | None = None, weights: Sequence[float] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """``keep`` (default doc_id) with size, source_size, target, copies and taken = copies * size."""
    spark = docs.sparkSession
    keep = keep or ["doc_id"]
    sized = stored(docs.select(*keep, F.col("source").cast("string").alias("_source"), word_count("text").alias("size"),
                               F.xxhash64(F.col("doc_id").cast("string"), "text").alias("_h"), F.xxhash64("text").alias("_t"))
                   .withColumn("_c", size_class("size")), "mix-sizes")
    # One row per source and size class (at most 64 of them); the number of sources bounds what the driver sees.
    per: dict[str | None, dict[int, int]] = {}
    for r in sized.groupBy("_source", "_c").agg(F.sum("size").alias("n")).collect():
        per.setdefault(r["_source"], {})[r["_c"]] = r["n"]
    goal = targets([(s, sum(c.values())) for s, c in per.items()], weights, max_repeats)
    plan = spark.createDataFrame([(s, sum(c.values()), goal[s], rate_of(goal[s], c, max_repeats)) for s, c in per.items()],
                                 "s string, source_size long, target double, rate double")
    few = len(per) <= MAX_BROADCAST_SOURCES

    def ranked(rows: DataFrame, by_source: DataFrame) -> DataFrame:
        """Rows with their source's plan, the certain copies, the Pareto ratio of the rest and its bin."""
        u = (F.expr("_h & 4503599627370495L").cast("double") + 0.5) / F.lit(float(1 << 52))
        expected = F.least(F.col("rate") * F.least(class_weight(F.col("_c")), F.lit(1.0)), F.lit(float(max_repeats)))
        return (rows.join(F.broadcast(by_source) if few else by_source, F.col("_source").eqNullSafe(F.col("s")))
                .withColumn("_sure", F.floor(expected + F.lit(1e-9)))
                .withColumn("_p", F.greatest(expected - F.col("_sure"), F.lit(0.0)))
                .withColumn("_q", F.when(F.col("_p") > 1e-9, (u / (1 - u)) * ((1 - F.col("_p")) / F.col("_p"))))
                .withColumn("_bin", F.floor(F.col("_q") / (1 + F.col("_q")) * BINS).cast("int")))

    # Words still missing after the certain copies, and where the running sum over bins meets them.
    per_bin = (ranked(sized.select("_source", "size", "_c", "_h"), plan).groupBy("s", "_bin")
               .agg(F.sum(F.when(F.col("_bin").isNotNull(), F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("_sure") * F.col("size")).alias("sure")))
    w = Window.partitionBy("s")
    steps = (per_bin.join(F.broadcast(plan) if few else plan, per_bin["s"].eqNullSafe(plan["s"])).drop(plan["s"])
             .withColumn("need", F.col("target") - F.sum("sure").over(w))
             .withColumn("before", F.sum("words").over(w.orderBy(F.col("_bin").asc_nulls_first())) - F.col("words")))
    open_ = F.col("_bin").isNotNull() & (F.col("before") < F.col("need"))
    cuts = stored(steps.groupBy("s", "source_size", "target", "rate").agg(
        F.first("need").alias("need"), F.max(F.when(open_, F.col("_bin"))).alias("cut"), F.max(F.when(open_, F.col("before"))).alias("before")), "mix-cuts")
    dealt = ranked(sized, cuts)
    # Bins before the cut are taken whole, those after it not; only the cut's is put in order.
    in_cut = F.coalesce(F.col("_bin") == F.col("cut"), F.lit(False))
    order = Window.partitionBy("s", "_bin").orderBy("_q", "_h", "size", "_t")
    inner = (dealt.filter(in_cut)
             .withColumn("_upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("_more", (F.col("_upto") - F.col("size") / 2.0) <= F.col("need")).drop("_upto"))
    rest = dealt.filter(~in_cut).withColumn("_more", F.coalesce(F.col("_bin") < F.col("cut"), F.lit(False)))
    return (rest.unionByName(inner)
            .withColumn("copies", F.col("_sure").cast("long") + F.col("_more").cast("long"))
            .select(*keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))

"""Exact dedup (operator 11), DataFrame functions only.

Two passes over compact rows (id, length, digest), never over texts. The first counts
the bits that all digests set in a blocked Bloom filter and keeps the bits that were set
at least twice. The second tests every row against those: a row with a bit that nobody
else set has no equal and passes straight through; only the others, possibly repeated,
shuffle and are grouped by their whole digest, which removes the false positives.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``;
their SHA-256 stands for them. Of equal texts the row with the most code points stays,
then the smallest id (null ids last), then the first read.

Edge cases: a null text counts as empty, and all texts without a visible character are
equal; rows repeating an id, or without one, are rows like any other, and exactly one row
of a group is kept; an empty table gives an empty result; further columns are ignored
unless named in ``keep``.

Groups of any size: counts and winners are aggregates with map-side combine. Verdicts
are joined back by digest; those of groups above 1/10,000 of all rows, at most 10,000 of them, are
broadcast, so no join key holds more than that share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import stored

#: Words of 64 bits in a filter block, and filter bits for each row of the table.
WORDS, BITS_PER_ROW = 8, 16
BLOCK_BITS = 64 * WORDS
#: A filter of up to so many blocks (about 120 bytes each) is broadcast, a longer one joined by block.
MAX_BROADCAST_BLOCKS = 1 << 18
#: Groups of more than rows / HOT_SHARE rows are hot: fewer than HOT_SHARE of them can exist.
HOT_SHARE, LEAST_HOT = 10_000, 1_000
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of a text without its white space; null counts as empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")
    return F.unhex(F.sha2(bare, 256))


def _bits(sha: str, n_blocks: int) -> tuple[Column, list[Column]]:
    """The block of a digest and its two different bits there."""
    h = F.xxhash64(sha, F.lit(1))
    one = h.bitwiseAND(F.lit(BLOCK_BITS - 1))
    step = F.pmod(F.shiftright(h, 16), F.lit(BLOCK_BITS - 1)) + 1
    return F.pmod(F.xxhash64(sha), F.lit(n_blocks)), [one, one.bitwiseXOR(step)]


def repeated_bits(rows: DataFrame, sha: str, n_blocks: int) -> DataFrame:
    """First pass: (block, words) of the filter bits set by two rows or more. What shuffles
    is a number and a count for each bit a task has met."""
    block, bits = _bits(sha, n_blocks)
    twice = (rows.select(F.explode(F.array(*[block * BLOCK_BITS + b for b in bits])).alias("slot"))
             .groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    word = F.pmod(F.floor(F.col("slot") / 64), F.lit(WORDS))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(64)).cast("int"))
    return (twice.select(F.floor(F.col("slot") / BLOCK_BITS).alias("_block"), word.alias("word"), mask.alias("mask"))
            .groupBy("_block").agg(F.array(*[F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("mask"))), F.lit(0).cast("long"))
                                             for i in range(WORDS)]).alias("_words")))


def mark_repeated(rows: DataFrame, sha: str, again: DataFrame, n_blocks: int, broadcast: bool) -> DataFrame:
    """Second pass: ``_maybe``, whether another row may have the same digest. Without
    ``broadcast`` the compact rows go to the filter's blocks instead."""
    block, bits = _bits(sha, n_blocks)
    hit = F.col("_words").isNotNull()
    for b in bits:
        word = F.get("_words", F.floor(b / 64).cast("int"))
        hit = hit & (F.call_function("getbit", word, F.pmod(b, F.lit(64)).cast("int")) == 1)
    joined = rows.withColumn("_block", block).join(F.broadcast(again) if broadcast else again, "_block", "left")
    return joined.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("_maybe"))


def exact_dedup(docs: DataFrame, keep: Sequence[str] = (), max_blocks: int = MAX_BROADCAST_BLOCKS,
                least_hot: int = LEAST_HOT) -> DataFrame:
    """(doc_id, *keep, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    The rows are written once to the shared folder as (doc_id, ``keep``, length, digest), so
    texts are read once, and only carried where ``keep`` names them.
    """
    out = ["doc_id", *keep]
    if set(out) & set(RESULT):
        raise ValueError(f"keep holds a result column: {sorted(set(out) & set(RESULT))}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(docs.select(*out, F.length(text).alias("_n"), digest(text).alias("_sha"),
                              F.monotonically_increasing_id().alias("_row")), "exact-rows")
    total = rows.count()
    n_blocks = max(1, -(-total * BITS_PER_ROW // BLOCK_BITS))
    again = stored(repeated_bits(rows, "_sha", n_blocks), "exact-bits")
    marked = mark_repeated(rows, "_sha", again, n_blocks, again.count() <= max_blocks)

    single = marked.filter(~F.col("_maybe")).select(
        *out, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha")

    maybe = stored(marked.filter("_maybe").drop("_maybe"), "exact-maybe")
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row"))
    groups = stored(maybe.groupBy("_sha").agg(F.count(F.lit(1)).alias("group_size"), best.alias("_best")), "exact-groups")
    bound = max(least_hot, total // HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col("group_size") > bound))
    cold = groups.filter(F.col("group_size") <= bound)
    settled = maybe.join(hot, "_sha").unionByName(maybe.join(hot.select("_sha"), "_sha", "left_anti").join(cold, "_sha"))
    settled = settled.select(*out, F.col("_best.doc_id").alias("keep_id"), "group_size",
                             (F.col("_row") == F.col("_best._row")).alias("kept"), "_sha")
    return (single.unionByName(settled)
            .select(*out, "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256")))

"""Rate limiting of keys that never pause: a speculative fold in blocks.

:func:`leadflow.operators.ratelimit.rate_limit` splits a key's requests at pauses of 61 s; a key without
such pauses is one session, hence one task. Here the clock is cut into slices, and each block
(key, slice) is folded by itself, as if its bucket were full at its first request. A block's *summary*
(first and last clock, tokens left) is all that the others need of it:

1. Fold all blocks in parallel, keep the summaries.
2. Each block's true opening is what the block before it left. Where that, refilled, is the very
   number of tokens the block started from, its summary stands. A bucket that was full at the cut, or
   fills up before the block's end, hands on what was assumed, bit for bit.
3. Fold the other blocks again from what now stands before them. Repeat until nothing
   changes, ``rounds`` times at most.
4. A key that is over its limit without a break never fills its bucket, so its state goes on from cut to
   cut. What is still open then is folded in order, one task a chain: narrow rows in, one summary a
   block out.
5. All openings are known now: fold all blocks once more in parallel, with the carried columns.

The openings travel as header rows at the head of their block, so the log is never joined to
them in steps 3 to 5. Memory is bounded: Arrow batches stream through with one open bucket.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.operators.ratelimit import SESSION_GAP_US, SLICE_US, fold_sorted
from leadflow.session import scratch_path

#: Clock of a header row: before every request.
HEADER = -(1 << 63)
BLOCK = "_k string, _b long, _first long, _limit long, _last long, _end double"


def _fold(batches: Iterator[pa.RecordBatch], summaries: bool) -> Iterator[pa.RecordBatch]:
    """Rows (_k, _c, _b, _t, _l, id, _tokens, _since, carried...) sorted by (_k, _c, _t, id). A run (_k, _c) starts
    from its header (_tokens left at _since), or full. Gives a row per block (_b), or all rows."""
    state: dict = {}
    opening: tuple | None = None            # of a header whose run has not begun yet
    block: list | None = None
    done: list[list] = []

    def flush():
        cols = list(zip(*done)) or [[]] * 6
        done.clear()
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["_k", "_b", "_first", "_limit", "_last", "_end"])

    for b in batches:
        if not b.num_rows:
            continue
        clock = b.column(3).to_numpy(zero_copy_only=False)
        heads = clock == HEADER
        rows = np.flatnonzero(~heads)
        opened = {}
        if opening is not None and len(rows) and rows[0] == 0:
            opened[0], opening = opening, None
        for h in np.flatnonzero(heads):
            start = (b.column(6)[int(h)].as_py(), b.column(7)[int(h)].as_py())
            at = int(np.searchsorted(rows, h))
            if at < len(rows):
                opened[at] = start
            else:
                opening = start
        if not len(rows):
            continue
        part = b if len(rows) == b.num_rows else b.take(pa.array(rows))
        keys, runs, blocks, clocks, limits = (part.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if 0 in opened:
            state = {}
        allowed, after = fold_sorted(keys, runs, clocks, limits, state, opened)
        if not summaries:
            yield pa.RecordBatch.from_arrays([part.column(5), pa.array(allowed), pa.array(after), *part.columns[8:]],
                                             [part.schema.names[5], "allowed", "tokens_after", *part.schema.names[8:]])
            continue
        cut = np.ones(len(rows), bool)
        cut[1:] = (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(rows)) - 1
        for i, j in zip(begin.tolist(), end.tolist()):
            if block is not None and block[0] == keys[i] and block[1] == blocks[i]:
                block[4:] = [int(clocks[j]), float(after[j])]
                continue
            if block is not None:
                done.append(block)
            block = [keys[i], int(blocks[i]), int(clocks[i]), int(limits[i]), int(clocks[j]), float(after[j])]
        if done:
            yield flush()
    if block is not None:
        done.append(block)
        yield flush()


def _dealt(rows: DataFrame, headers: DataFrame | None, rid: str, n: int) -> DataFrame:
    """Rows and headers by run, each run in order."""
    names = ["_k", "_c", "_b", "_t", "_l", rid, "_tokens", "_since"]
    rows = rows.withColumns({"_tokens": F.lit(None).cast("double"), "_since": F.lit(None).cast("long")})
    rows = rows.select(*names, *[c for c in rows.columns if c not in names])
    if headers is not None:
        heads = headers.select("_k", "_c", "_b", F.lit(HEADER).cast("long").alias("_t"), F.lit(0).cast("long").alias("_l"),
                               F.lit(None).cast(rows.schema[rid].dataType).alias(rid), "_tokens", "_since")
        rows = rows.unionByName(heads, allowMissingColumns=True)
    return rows.repartition(n, "_k", "_c").sortWithinPartitions("_k", "_c", "_t", rid)


def _summaries(rows: DataFrame, headers: DataFrame | None, rid: str, n: int) -> DataFrame:
    return _dealt(rows, headers, rid, n).mapInArrow(lambda batches: _fold(batches, True), BLOCK)


def _openings(blocks: DataFrame) -> DataFrame:
    """Adds what the block before left (``_tokens`` at ``_since``; null: none, or 61 s before) and
    ``_arrive``, the tokens at the first request. A window has a key's summaries, not its rows."""
    w = Window.partitionBy("_k").orderBy("_b")
    near = (F.col("_first") - F.lag("_last").over(w)) < SESSION_GAP_US
    limit = F.col("_limit").cast("double")
    out = blocks.withColumns({"_tokens": F.when(near, F.lag("_end").over(w)), "_since": F.when(near, F.lag("_last").over(w))})
    refilled = F.col("_tokens") + ((F.col("_first") - F.col("_since")).cast("double") / 1e6) * (limit / 60.0)
    return out.withColumn("_arrive", F.when(F.col("_since").isNull(), limit).otherwise(F.least(limit, refilled)))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again (summaries: a row per block)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_blocks(rows: DataFrame, rid: str, n: int, rounds: int) -> tuple[DataFrame, list[int]]:
    """Exact summaries of all blocks with their openings, and how many blocks each round folded again (the
    last number: blocks folded in order)."""
    blocks = _kept(_summaries(rows, None, rid, n).withColumn("_assumed", F.col("_limit").cast("double")), "blocks")
    folded = []
    while True:
        opened = _openings(blocks)
        wrong = opened.filter(F.col("_arrive") != F.col("_assumed"))
        todo = _kept(wrong.select("_k", F.col("_b").alias("_c"), "_b", "_tokens", "_since", "_arrive"), "blocks-open")
        left = todo.count()
        if not left:
            return opened.drop("_assumed"), folded
        folded.append(left)
        if len(folded) > rounds:
            break
        again = _summaries(rows.join(todo.select("_k", "_b"), ["_k", "_b"], "left_semi"), todo, rid, n).join(todo.select("_k", "_b", "_arrive"), ["_k", "_b"])
        blocks = _kept(blocks.join(again.select("_k", "_b", F.col("_end").alias("_new"), F.col("_arrive").alias("_from")), ["_k", "_b"], "left")
                       .withColumns({"_end": F.coalesce("_new", "_end"), "_assumed": F.coalesce("_from", "_assumed")}).drop("_new", "_from"), "blocks")

    # Chains: from a key's open block up to the next block that starts anew after a pause.
    w = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    opened = opened.withColumn("_open", F.col("_arrive") != F.col("_assumed"))
    chains = opened.withColumn("_session", F.last(F.when(F.col("_since").isNull(), F.col("_b")), ignorenulls=True).over(w))
    in_session = Window.partitionBy("_k", "_session").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    chains = chains.withColumn("_c", F.min(F.when(F.col("_open"), F.col("_b"))).over(in_session))
    chains = _kept(chains.filter(F.col("_c").isNotNull()).select("_k", "_b", "_c", "_tokens", "_since"), "blocks-chains")
    folded[-1] = chains.count()
    in_order = rows.drop("_c").join(chains.select("_k", "_b", "_c"), ["_k", "_b"])
    ends = _summaries(in_order, chains.filter(F.col("_c") == F.col("_b")), rid, n).select("_k", "_b", F.col("_end").alias("_new"))
    blocks = _kept(blocks.join(ends, ["_k", "_b"], "left").withColumn("_end", F.coalesce("_new", "_end")).drop("_new"), "blocks")
    return _openings(blocks).drop("_assumed"), folded


def rate_limit_blocks(requests: DataFrame, key: str = "key_hash", clock: str = "clock_us", limit: str = "rate_limit",
                      rid: str = "request_id", partitions: int | None = None, slice_us: int = SLICE_US,
                      carry: Sequence[str] = (), rounds: int = 3) -> DataFrame:
    """``(request_id, allowed, tokens_after, *carry)`` as :func:`ratelimit.rate_limit` gives them, with the
    requests of one endless session spread over the slices of its clock. Jobs run when it is called."""
    n = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block: Column = F.floor(F.col(clock) / F.lit(slice_us)).cast("long")
    rows = requests.select(F.col(key).alias("_k"), block.alias("_c"), block.alias("_b"), F.col(clock).alias("_t"),
                           F.col(limit).cast("long").alias("_l"), F.col(rid).cast("long").alias(rid), *carry)
    blocks, _ = settle_blocks(rows.select("_k", "_c", "_b", "_t", "_l", rid), rid, n, rounds)
    headers = blocks.filter(F.col("_arrive") < F.col("_limit")).select("_k", F.col("_b").alias("_c"), "_b", "_tokens", "_since")
    schema = rows.select(rid).schema.add("allowed", "boolean").add("tokens_after", "double")
    for f in rows.select(*carry).schema.fields:
        schema = schema.add(f)
    return _dealt(rows, headers, rid, n).mapInArrow(lambda batches: _fold(batches, False), schema)

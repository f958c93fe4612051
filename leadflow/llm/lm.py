"""LM scoring (operator 9): a hashed maximum-entropy model.

A word belongs to one of ``CLASSES`` classes and, within it, to one of ``MEMBERS`` buckets
(by a hash of its ending, or of the whole of a short word). Its probability is

    P(class | history) * P(bucket | class, history) * (c + 1) / (sum of c + 1 in the bucket),

c being its training count; a word never seen in training shares one event per bucket. The
first two are softmaxes over log-linear scores: a prior from the bucket counts, plus
weights of the previous bucket (n-gram), the one before it (skip) and both (hashed). Weights
are trained in rounds over disjoint parts of the training documents: every task takes
normalised gradient steps over its blocks from the last round's weights, and the steps
are averaged over the tasks, in two summing passes. Each training document is used once.

Documents are cut into blocks of bounded size. A block keeps its documents'
bucket sequences and, as an inverted index, a row per distinct word with the
documents that hold it; counts of words (which grow with the corpus, and are never
broadcast or collected) are joined to the index, not to texts. Weights have a fixed
size; they alone, and the bucket totals, reach the driver.

Edge cases: null and empty texts have one token, the end; repeated rows and null
doc_ids each get their row (a null id is not held out); with no training text every word
is unknown; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import in_fold, lower_words, stored

CLASSES, MEMBERS = 16, 32
BUCKETS = CLASSES * MEMBERS
#: Stands for the words before a text.
START = BUCKETS
PAIRS = 1 << 13
END = b" "  # no word holds a space
BLOCK_DOCS, BLOCK_TOKENS = 8192, 2_000_000
#: Sums of this many documents are held by a task before they are passed on.
HELD_SUMS = 1 << 22
ROUNDS = 3
STEP, DAMP = 1.5, 30.0
BATCH = 8192
#: The weight tables, one after the other: name, rows, columns.
SHAPES = [("class_prev", BUCKETS + 1, CLASSES), ("class_skip", BUCKETS + 1, CLASSES), ("class_pair", PAIRS, CLASSES),
          ("member_prev", (BUCKETS + 1) * CLASSES, MEMBERS), ("member_skip", (BUCKETS + 1) * CLASSES, MEMBERS)]
SIZE = sum(r * c for _, r, c in SHAPES)
PIECE = 1 << 15


def bucket(word: bytes) -> int:
    return zlib.crc32(word if len(word) <= 4 else word[-3:]) % BUCKETS


def bucket_column(word: str) -> F.Column:
    """`bucket` of a string column."""
    raw = F.col(word).cast("binary")
    return F.pmod(F.crc32(F.when(F.octet_length(word) <= 4, raw).otherwise(F.substring(raw, -3, 3))), F.lit(BUCKETS)).cast("int")


def _binaries(values: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Binary cells of ``lens`` items each, cut from ``values``."""
    offsets = np.concatenate([[0], np.cumsum(lens * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


#: postings: (document of the block, times) in pairs of uint16.
BLOCK_SCHEMA = ("block long, word string, n_train long, postings binary, "
                "doc_ids binary, nulls binary, held binary, lens binary, toks binary")
_NAMES = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]


def _block_rows(number: int, ids: list[int | None], held: list[bool], texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    held_ = np.array(held, bool)
    place: dict[bytes, int] = {}
    seen = np.fromiter([place.setdefault(w, len(place)) for t in texts for w in t], np.int64, int(lens.sum()))
    buckets = np.fromiter(map(bucket, place), np.int32, len(place))
    doc = np.repeat(np.arange(len(texts)), lens)
    key, times = np.unique(seen * BLOCK_DOCS + doc, return_counts=True)
    word, at = key // BLOCK_DOCS, key % BLOCK_DOCS
    train = np.bincount(word, times * ~held_[at], len(place)).astype(np.int64)
    # A word more frequent than a uint16 holds has its posting repeated.
    parts = 1 + (times - 1) // 65535
    pair = np.empty((int(parts.sum()), 2), np.uint16)
    pair[:, 0] = np.repeat(at, parts)
    pair[:, 1] = 65535
    pair[np.cumsum(parts) - 1, 1] = times - (parts - 1) * 65535
    n = np.bincount(word, parts, len(place)).astype(np.int64)
    postings = _binaries(pair.view(np.uint32).ravel(), n)
    words = pa.array(list(place), pa.binary()).cast(pa.string())
    v = len(place)
    for lo in range(0, v, 1 << 16):
        m = min(1 << 16, v - lo)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, number)), words.slice(lo, m), pa.array(train[lo:lo + m]), postings.slice(lo, m), *[pa.nulls(m, pa.binary())] * 5], _NAMES)
    null = np.array([i is None for i in ids], bool)
    whole = [np.array([i or 0 for i in ids], np.int64), null, held_, lens.astype(np.int32), buckets[seen].astype(np.uint16)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
         *[pa.array([x.tobytes()], pa.binary()) for x in whole]], _NAMES)


def blocks(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """Index rows (word given) and block rows (word null) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list = []
        texts: list = []
        size = 0
        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                w = lower_words(t.as_py())
                w.append(END)
                if texts and (len(texts) >= BLOCK_DOCS or size + len(w) > BLOCK_TOKENS):
                    yield from _block_rows(number, ids, held, texts)
                    ids, held, texts, size = [], [], [], 0
                    number += 1
                ids.append(i)
                held.append(h)
                texts.append(w)
                size += len(w)
        if texts:
            yield from _block_rows(number, ids, held, texts)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, BLOCK_SCHEMA))


def _history(toks: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous bucket, the one before, and their hashed pair, for every token."""
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
    prev = np.concatenate([[START], toks[:-1]]).astype(np.int64)
    skip = np.concatenate([[START, START], toks[:-2]])[:len(toks)].astype(np.int64)
    prev[starts] = START
    skip[starts] = START
    second = starts[lens > 1] + 1
    skip[second] = START
    return prev, skip, (prev * 40503 + skip * 30011) % PAIRS


class MaxEnt:
    def __init__(self, totals: np.ndarray, flat: np.ndarray) -> None:
        """totals: sum of c + 1 of each bucket, its share for unseen words included."""
        t = totals.reshape(CLASSES, MEMBERS)
        self.class_prior = np.log(t.sum(1)).astype(np.float32)
        self.member_prior = np.log(t).astype(np.float32)
        self.t = {}
        at = 0
        for name, r, c in SHAPES:
            self.t[name] = flat[at:at + r * c].reshape(r, c)
            at += r * c

    def probabilities(self, cls: np.ndarray, prev: np.ndarray, skip: np.ndarray, pair: np.ndarray):
        """Softmax over classes, and over the members of the given class."""
        t = self.t
        a = self.class_prior + t["class_prev"][prev] + t["class_skip"][skip] + t["class_pair"][pair]
        b = self.member_prior[cls] + t["member_prev"][prev * CLASSES + cls] + t["member_skip"][skip * CLASSES + cls]
        out = []
        for x in (a, b):
            x -= x.max(1, keepdims=True)
            np.exp(x, out=x)
            x /= x.sum(1, keepdims=True)
            out.append(x)
        return out

    def log_prob(self, toks: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Natural log of P(class) * P(bucket | class) of every token."""
        prev, skip, pair = _history(toks, lens)
        out = np.empty(len(toks))
        for lo in range(0, len(toks), BATCH):
            s = slice(lo, lo + BATCH)
            cls, member = np.divmod(toks[s].astype(np.int64), MEMBERS)
            a, b = self.probabilities(cls, prev[s], skip[s], pair[s])
            row = np.arange(len(cls))
            out[s] = np.log(a[row, cls].astype(np.float64)) + np.log(b[row, member].astype(np.float64))
        return out

    def learn(self, toks: np.ndarray, lens: np.ndarray) -> None:
        """Gradient steps over batches; a feature's step is normalised by its number of uses."""
        prev, skip, pair = _history(toks, lens)
        for lo in range(0, len(toks), BATCH):
            s = slice(lo, lo + BATCH)
            cls, member = np.divmod(toks[s].astype(np.int64), MEMBERS)
            a, b = self.probabilities(cls, prev[s], skip[s], pair[s])
            row = np.arange(len(cls))
            a[row, cls] -= 1
            b[row, member] -= 1
            for name, feature, g in (("class_prev", prev[s], a), ("class_skip", skip[s], a), ("class_pair", pair[s], a),
                                     ("member_prev", prev[s] * CLASSES + cls, b), ("member_skip", skip[s] * CLASSES + cls, b)):
                order = np.argsort(feature, kind="stable")
                f = feature[order]
                first = np.concatenate([[0], np.flatnonzero(np.diff(f)) + 1])
                uses = np.diff(np.append(first, len(f)))[:, None]
                self.t[name][f[first]] -= STEP * np.add.reduceat(g[order], first, axis=0) / (uses + DAMP)


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["toks"], np.uint16), np.frombuffer(row["lens"], np.int32), np.frombuffer(row["held"], bool)


def _round(table: DataFrame, number: int, totals: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The weights after one round over the blocks of this round."""
    sent = table.sparkSession.sparkContext.broadcast((totals, flat))  # of fixed size

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tot, start = sent.value
        mine = start.copy()
        model, seen = MaxEnt(tot, mine), 0
        for b in batches:
            for row in b.to_pylist():
                toks, lens, held = _arrays(row)
                pick = np.repeat(~held, lens)
                if pick.any():
                    model.learn(toks[pick], lens[~held])
                    seen += int(pick.sum())
        if seen:
            step = (mine - start).astype(np.float16)  # half the bytes; a step's rounding is far below its noise
            for k, lo in enumerate(range(0, SIZE, PIECE)):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([seen]), pa.array([step[lo:lo + PIECE].tobytes()], pa.binary())], ["piece", "seen", "step"])

    def add(kind: type):
        """Sum the steps of a piece, weighted by the tokens they rest on (once)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for b in batches:
                for k, m, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    v = np.frombuffer(x, kind).astype(np.float64) * (m if kind is np.float16 else 1)
                    if k in sums:
                        sums[k][0] += m
                        sums[k][1] += v
                    else:
                        sums[k] = [m, v]
            for k, (m, v) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([m]), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["piece", "seen", "step"])
        return run

    schema = "piece long, seen long, step binary"
    part = (table.filter(F.col("word").isNull() & (F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == number)).select("lens", "held", "toks")
            .mapInArrow(steps, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
            .repartition("piece", "salt").select("piece", "seen", "step").mapInArrow(add(np.float16), schema)
            .repartition("piece").mapInArrow(add(np.float32), schema))
    out = flat.copy()
    for r in part.collect():  # SIZE weights in all
        x = np.frombuffer(r.step, np.float32)
        out[r.piece * PIECE:r.piece * PIECE + len(x)] += x / np.float32(r.seen)
    return out


def lm_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): learned from
    documents whose crc32 of the id mod ``modulus`` is not ``remainder``."""
    table = stored(blocks(docs, in_fold("doc_id", modulus, remainder)), "lm-blocks")
    index = table.filter(F.col("word").isNotNull())
    counts = stored(index.groupBy("word").agg(F.sum("n_train").alias("c")).filter("c > 0"), "lm-counts")
    by_bucket = counts.groupBy(bucket_column("word").alias("bucket")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()  # BUCKETS rows
    n, v = sum(r.c for r in by_bucket), sum(r.v for r in by_bucket)
    totals = np.ones(BUCKETS)
    for r in by_bucket:
        totals[r.bucket] += r.c + r.v
    flat = np.zeros(SIZE, np.float32)
    for k in range(ROUNDS):
        flat = _round(table, k, totals, flat)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum over this task's words, per document: postings shrink to sums before the shuffle."""
        sums: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for k, (log, known) in sums.items():
                at = np.flatnonzero(known)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k]), *[pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.uint16), log[at], known[at].astype(np.int64))]], ["b", "at", "log", "known"])
            sums.clear()

        for b in batches:
            size = np.fromiter(map(len, cells := b.column(2).to_pylist()), np.int64, b.num_rows) // 4
            pair = np.frombuffer(b"".join(cells), np.uint16).reshape(-1, 2)
            at, times = pair[:, 0].astype(np.int64), pair[:, 1].astype(np.float64)
            which, inverse = np.unique(b.column(0).to_numpy(), return_inverse=True)
            at += np.repeat(inverse, size) * BLOCK_DOCS
            log = np.bincount(at, times * np.repeat(np.log10(b.column(1).to_numpy() + 1.0), size), len(which) * BLOCK_DOCS).reshape(-1, BLOCK_DOCS)
            known = np.bincount(at, times, len(which) * BLOCK_DOCS).reshape(-1, BLOCK_DOCS)
            for k, x, y in zip(which.tolist(), log, known):
                mine = sums.setdefault(k, np.zeros((2, BLOCK_DOCS)))
                mine[0] += x
                mine[1] += y
            if len(sums) * BLOCK_DOCS > HELD_SUMS:
                yield from out()
        yield from out()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for row in b.to_pylist():
                at = np.frombuffer(row["at"], np.uint16)
                mine = sums.setdefault(row["b"], np.zeros((2, BLOCK_DOCS)))
                mine[0][at] += np.frombuffer(row["log"])
                mine[1][at] += np.frombuffer(row["known"], np.int64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x.tobytes()], pa.binary())], ["b", "sums"])

    known = (index.select("block", "word", "postings").join(counts, "word").select("block", "c", "postings")
             .mapInArrow(partial, "b long, at binary, log binary, known binary").repartition("b").mapInArrow(total, "b long, sums binary"))
    sent = docs.sparkSession.sparkContext.broadcast((totals, flat))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tot, weights = sent.value
        model, base = MaxEnt(tot, weights), np.log10(n + v + 1.0)
        share = np.log10(tot)
        for b in batches:
            for row in b.to_pylist():
                toks, lens, held = _arrays(row)
                ids, null = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["nulls"], bool)
                seen = np.frombuffer(row["sums"]).reshape(2, BLOCK_DOCS)[:, :len(lens)] if row["sums"] else np.zeros((2, len(lens)))
                starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
                each = model.log_prob(toks, lens) / np.log(10) - share[toks]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=null), pa.array(held), pa.array(lens.astype(np.int64)), pa.array(seen[1].astype(np.int64)), pa.array(np.full(len(lens), n)),
                     pa.array(seen[0] - lens * base), pa.array(seen[0] + np.add.reduceat(each, starts))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = table.filter(F.col("word").isNull()).select("block", "doc_ids", "nulls", "held", "lens", "toks")
    return (rows.join(known, F.col("block") == F.col("b"), "left").drop("block", "b")
            .mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))

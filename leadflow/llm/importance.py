"""Target-distribution importance resampling (operator 13).

Documents are drawn so that their hashed word n-grams come near those of a target table. A
text is cut at its newlines; what a line contributes (its words, their buckets, its first and last word) is
computed once for a distinct line and multiplied by its occurrences, and the n-grams that
cross from a line to the next are added separately, once for a distinct pair of words.
Distinct lines are held per task in a table of bounded size that is emptied when full, so no line is
shuffled and memory does not grow with the input: a line costs its work once for each filling of
a task's table. What leaves a task is one row a bucket.

Edge cases: a null text, and a text without words, has no features and weight 0; lines
without words are passed over (the words around them are neighbours); a null id is hashed as
the empty string and comes last among ties; rows repeating an id are rows like any other and
each gets its own rank; an empty table gives an empty result, an empty target table gains from
smoothing alone; very long lines are worked on whole; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import stored
from leadflow.sinks.writers import chunk_index

#: Words of UTF-8 text in which A-Z are lower case: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Features are hashed to so many buckets.
BUCKETS = 10_000
#: Bytes of distinct lines (with 200 for the upkeep of each) that a task holds at most, beyond its last line.
TABLE_BYTES = 32 << 20


class Lines:
    """What distinct lines and distinct line crossings contribute, with their occurrences."""

    def __init__(self, buckets: int, gains: np.ndarray | None = None):
        self.buckets, self.gains = buckets, gains
        self.clear()

    def clear(self) -> None:
        self.lines: dict[bytes, list] = {}
        self.crossings: dict[tuple[bytes, bytes], list] = {}
        self.held = 0

    def _line(self, line: bytes) -> list:
        """[occurrences, number of words, first word, last word, buckets of the features, their gains]."""
        words = _WORDS.findall(line)
        sums = [crc32(w) for w in words]
        pairs = [crc32(w, crc32(b" ", s)) for s, w in zip(sums, words[1:])]
        slots = np.array(sums + pairs, np.uint32) % np.uint32(self.buckets)
        gain = int(self.gains[slots].sum()) if self.gains is not None and words else 0
        self.held += len(line) + slots.nbytes + 200
        return [0, len(words), words[0] if words else b"", words[-1] if words else b"", slots, gain]

    def _crossing(self, last: bytes, first: bytes) -> list:
        slot = crc32(first, crc32(b" ", crc32(last))) % self.buckets
        self.held += len(last) + len(first) + 200
        return [0, slot, 0 if self.gains is None else int(self.gains[slot])]

    def add(self, text: str) -> tuple[int, int]:
        """Counts a text's lines and crossings; (words, sum of the gains of its features)."""
        n, gain, before = 0, 0, b""
        for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):
            known = self.lines.get(line)
            if known is None:
                known = self.lines[line] = self._line(line)
            known[0] += 1
            if not known[1]:
                continue
            if before:
                pair = (before, known[2])
                crossing = self.crossings.get(pair)
                if crossing is None:
                    crossing = self.crossings[pair] = self._crossing(*pair)
                crossing[0] += 1
                gain += crossing[2]
            n, gain, before = n + known[1], gain + known[5], known[3]
        return n, gain

    def into(self, counts: np.ndarray) -> None:
        """Adds every feature, as often as its line or crossing occurred, to ``counts``."""
        for times, _, _, _, slots, _ in self.lines.values():
            np.add.at(counts, slots, times)
        for times, slot, _ in self.crossings.values():
            counts[slot] += times


def feature_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): all features of column ``text``, repeats counted, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = Lines(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                table.add(x.as_py() or "")
                if table.held > TABLE_BYTES:
                    table.into(counts)
                    table.clear()
        table.into(counts)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(counts[some])], ["bucket", "n"])

    per_task = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the documents') of each bucket. The two
    counts, ``buckets`` rows at most, come to the driver."""

    def dense(counts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.float64)
        for r in counts.collect():
            out[r.bucket] = r.n
        return out

    s, t = dense(feature_counts(documents, buckets)), dense(feature_counts(target, buckets))
    share = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def weights(documents: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Lines(len(gains), gains)
        for b in batches:
            words, features, weight = [], [], []
            for x in b.column(1):
                n, gain = table.add(x.as_py() or "")
                f = 2 * n - 1 if n else 0
                words.append(n)
                features.append(f)
                weight.append(gain // f if f else 0)
                if table.held > TABLE_BYTES:
                    table.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in (words, features, weight)]],
                                             ["doc_id", "n_words", "n_features", "weight"])

    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 x a Gumbel draw) from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(documents: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20,
             seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): the ``percent`` of the documents of at least
    ``least_words`` words with the highest scores have ranks from 1, others null.

    Ranks are positions in a range-sorted table of compact rows: neither a window nor a task
    holds all of them, and equal scores and ids are parted by a row number.
    """
    scored = weights(documents, bucket_gains(documents, target, buckets))
    scored = stored(scored.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"),
                                  F.monotonically_increasing_id().alias("id_row")), "importance")
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("id_row")]
    placed = chunk_index(scored.filter(able), order, 1).withColumn("rank", F.when(F.col("_row") < drawn, F.col("_row") + 1))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.select(*columns).unionByName(rest.select(*columns))

"""SimHash near-duplicates (operator 4).

Fingerprints are made per Arrow batch. Equal fingerprints collapse to one row
first, so a large group of copies is one fingerprint. Fingerprints within
``max_bits`` agree on at least ``BLOCKS - max_bits`` of ``BLOCKS`` bit blocks, so each
is dealt to one bucket per choice of that many blocks. Within a bucket the pivot
tables do the work: every fingerprint carries its Hamming distances to many
reference fingerprints, and a pair is discarded when any of those coordinates
differ by more than ``max_bits`` (triangle inequality); survivors are verified
exactly. Only a spanning forest of the links leaves a bucket, never its pairs.
Buckets above ``TILE`` rows are cut into tiles by pivot coordinate and salt, and
tiles meet pairwise, so no task holds a whole hot bucket.

Edge cases: null or wordless texts have fingerprint zero and link like any other;
fewer words than a shingle: the whole sequence is the shingle; repeated rows and
equal doc_ids each get a row; null doc_ids link like any other and get the component of
their fingerprint (null where no document of it has an id); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import lower_words, slices, stored, with_text
from leadflow.llm.components import FEW, components

SEED = 42
BLOCKS = 5
TILE = 4096
PIVOTS = 16
_PIVOTS = np.random.default_rng(7).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of a text: a bit is set when over half the shingle hashes set it."""
    w = lower_words(text)
    if not w:
        return 0
    joined = b" ".join(w)
    n = len(w) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    lens = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(lens)
    starts = (ends - lens)[:n].tolist()
    stops = (ends - 1)[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):  # a very long text is counted in slices
        ones += np.unpackbits(h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3) -> DataFrame:
    """``keep`` columns, then fp long: the fingerprint's 64 bits as a signed long."""
    src, at = with_text(docs, keep)
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for b in batches for p in slices(b)):
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(at)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(fps.view(np.int64))], [*keep, "fp"])

    return src.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long)."""
    return with_fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], shingle)


def _block_key(fp: F.Column, chosen: tuple[int, ...], number: int) -> F.Column:
    cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
    mask -= (mask >> 63) << 64  # as a signed long
    return F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("bits"))


def _forest(fp: np.ndarray, rep: np.ndarray, dist: np.ndarray, max_bits: int,
            left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger id, smallest id of its group) that join all rows linked
    within one bucket tile. ``left``: only rows before it meet rows from it on."""
    n = len(fp)
    label = np.arange(n)
    order = np.argsort(dist[:, 0], kind="stable")
    first = dist[order, 0]
    ends = np.searchsorted(first, first + max_bits, "right")
    for at, i in enumerate(order):
        # First coordinate: a sorted window; the other pivots discard within it.
        js = order[at + 1:ends[at]]
        js = js[label[js] != label[i]]
        if left is not None:
            js = js[(js < left) != (i < left)]
        js = js[np.abs(dist[js] - dist[i]).max(1) <= max_bits] if len(js) else js
        js = js[np.bitwise_count(fp[js] ^ fp[i]) <= max_bits]
        if len(js):
            met = np.append(np.unique(label[js]), label[i])
            label[np.isin(label, met)] = met.min()
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, label, rep)
    low = low[label]
    return rep[rep != low], low[rep != low]


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges (a, b) between the ids ``rep`` of distinct fingerprints ``fp`` whose
    transitive closure is that of all pairs within ``max_bits``."""
    choices = list(combinations(range(BLOCKS), BLOCKS - max_bits))
    table = distinct.select(
        "fp", "rep",
        *[F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(p.astype(np.int64))))).cast("tinyint").alias(f"d{i}") for i, p in enumerate(_PIVOTS)])
    dealt = (table.withColumn("bucket", F.explode(F.array(*[_block_key(F.col("fp"), c, i) for i, c in enumerate(choices)])))
             .withColumn("bucket", F.xxhash64("bucket")))
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Merged: Spark sizes exploded rows by what they are exploded from, and may broadcast `dealt`.
    in_use = dealt.hint("merge").join(sizes, "bucket")

    cols = ["rep", "fp", *[f"d{i}" for i in range(PIVOTS)]]
    # Hot buckets: tiles (first pivot distance, salt); tiles whose distances are
    # within max_bits meet. `side` tells the two tiles of a meeting apart.
    hot = (in_use.filter(F.col("n") > TILE)
           .withColumn("salts", F.ceil(F.col("n") / TILE).cast("int"))
           .withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("salts")).cast("int"))
           .withColumn("mine", F.struct(F.col("d0").cast("int").alias("d"), F.col("salt").alias("s")))
           .withColumn("other", F.explode(F.expr(
               f"flatten(transform(sequence(int(d0) - {max_bits}, int(d0) + {max_bits}), "
               "x -> transform(sequence(0, salts - 1), y -> struct(x as d, y as s))))")))
           .select("bucket", F.xxhash64(F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"),
                   F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("tinyint").alias("side"), *cols))
    cold = in_use.filter(F.col("n") <= TILE).select("bucket", F.lit(0).cast("long").alias("tile"), F.lit(0).cast("tinyint").alias("side"), *cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close() -> pd.DataFrame | None:
            side, fp, rep, dist = (np.concatenate(x) for x in zip(*held)) if len(held) > 1 else held[0]
            left = None if side[0] == 0 else int((side == 1).sum())
            if len(fp) < 2 or left in (0, len(fp)):
                return None
            a, b = _forest(fp, rep, dist, max_bits, left)
            return pd.DataFrame({"a": a, "b": b}) if len(a) else None

        held: list[tuple[np.ndarray, ...]] = []
        key = None
        for pdf in batches:
            bucket, tile = pdf["bucket"].to_numpy(), pdf["tile"].to_numpy()
            whole = (pdf["side"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy(), pdf.iloc[:, 5:].to_numpy(np.int16))
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(pdf)]
            for lo, hi in zip(bounds, bounds[1:]):
                if lo == hi:
                    continue
                k = (bucket[lo], tile[lo])
                if k != key and held:
                    if (out := close()) is not None:
                        yield out
                    held = []
                key = k
                held.append(tuple(x[lo:hi] for x in whole))
        if held and (out := close()) is not None:
            yield out

    return (cold.unionByName(hot).repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "side")
            .select("bucket", "tile", "side", "fp", "rep", *cols[2:]).mapInPandas(run, "a long, b long"))


def fingerprint_groups(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, group) of every distinct ``fp``: the fingerprints themselves are linked, so a
    group needs no ids; it is named by its smallest fingerprint (as a signed long)."""
    distinct = fps.select("fp").distinct()
    # Merged: Spark sizes a stored table by its compressed files. A fingerprint has one row on either side.
    groups = components(links(distinct.withColumn("rep", F.col("fp")), max_bits)).hint("merge")
    return stored(distinct.join(groups, distinct["fp"] == groups["node"], "left")
                  .select("fp", F.coalesce("component", "fp").alias("group")), "groups")


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id
    reachable through links of at most ``max_bits`` (under ``BLOCKS``) differing bits."""
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    groups = fingerprint_groups(fps, max_bits)
    # Stored tables are broadcast by their rows alone: merged where a key has one row on either side, else on the
    # left of a left join (every row finds one). `least` is shuffled first, so Spark measures it.
    least = (fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(groups.hint("merge"), "fp")
             .groupBy("group").agg(F.min("rep").alias("component_id")))
    label = groups.join(least, "group", "left").select("fp", "component_id")
    return (fps.join(label if groups.count() <= FEW else label.hint("merge"), "fp", "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))

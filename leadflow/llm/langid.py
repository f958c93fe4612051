"""Language ID (operator 5): a string-kernel classifier.

The kernel is a blended spectrum of presence kernels: for each n in ``NGRAMS``, the
number of (hashed) byte n-grams two texts share over the square root of the product
of their numbers of n-grams; the blend is the mean. ``landmarks`` training texts span the
Nyström features, and one kernel ridge regression per language (target +1 or -1)
is fitted on them. The kernel is linear in a text's n-gram presence, so a batch is scored by the
product of its presence matrix with the landmarks' (n-gram bucket x landmark), or, with
fewer languages than landmarks, with the folded one (n-gram bucket x language).

Training uses at most ``per_lang`` texts of each language (of the smallest hashes of their
doc_id, one text an id; a documented bound on the fit) and every language. Tasks turn the sample into
Nyström features and send sums: the driver sees the landmarks, one matrix (landmark x landmark) a
task and one vector a language. Prediction covers every row.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; null langs are
never learned; without any labelled training row every text is ``und``; with one
language every text with letters is that language; repeated rows are predicted alike;
null doc_ids are predicted but not learned from; very long texts are read whole, in slices; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.llm.common import in_fold, slices, stored, with_text

NGRAMS = (2, 3, 4)
BUCKETS = 1 << 15
#: Hashed shares of a language in which the training cut is taken first, step by step.
SHARES = (64, 8)
#: Training ids are broadcast up to this number (some MB), joined beyond it.
MAX_BROADCAST_IDS = 200_000
#: Training texts in one task of the fit.
FIT_TEXTS = 20_000
UNKNOWN = "und"
_SLICE = 1 << 20


def presence(text: str) -> list[np.ndarray]:
    """For each n, the sorted hash buckets of the whole text's byte n-grams."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    out = []
    for n in NGRAMS:
        seen = np.zeros(BUCKETS, bool)
        for at in range(0, max(1, len(raw) - n + 1), _SLICE):  # a very long text goes in slices
            part = raw[at:at + _SLICE + n - 1]
            if len(part) < n:
                continue
            gram = np.zeros(len(part) - n + 1, np.uint32)
            for k in range(n):
                gram = (gram << np.uint32(8)) | part[k:len(part) - n + 1 + k]
            seen[(gram * np.uint32(2654435761)) >> np.uint32(32 - 15)] = True
        out.append(np.flatnonzero(seen))
    return out


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; numbers such as one half are none."""
    return bool(text) and any(map(str.isalpha, text))


DIMS = len(NGRAMS) * BUCKETS


@dataclass
class Table:
    """A sparse matrix (DIMS x columns) by its rows that are not zero."""

    place: np.ndarray                       # row of each dimension in ``rows``; the last one is zero
    rows: np.ndarray

    @property
    def columns(self) -> int:
        return self.rows.shape[1]

    def project(self, texts: list[list[np.ndarray]]) -> np.ndarray:
        """Texts' presence, each n scaled by the root of its size, times this matrix; one text's rows
        at a time."""
        out = np.zeros((len(texts), self.columns), np.float64)
        for i, text in enumerate(texts):
            for k, grams in enumerate(text):
                if len(grams):
                    at = self.place[grams + k * BUCKETS]
                    out[i] += self.rows[at[at < len(self.rows) - 1]].sum(0, dtype=np.float64) / np.sqrt(len(grams))
        return out


def landmark_table(marks: list[list[np.ndarray]]) -> Table:
    """DIMS x landmarks: texts projected on it are their kernel with the landmarks."""
    dims = [np.concatenate([g + k * BUCKETS for k, g in enumerate(t)]) for t in marks]
    used = np.unique(np.concatenate(dims)).astype(np.int64)
    place = np.full(DIMS, len(used), np.int32)
    place[used] = np.arange(len(used))
    rows = np.zeros((len(used) + 1, len(marks)), np.float32)
    for i, t in enumerate(marks):
        for k, g in enumerate(t):
            if len(g):
                rows[place[g + k * BUCKETS], i] = 1 / (np.sqrt(len(g)) * len(NGRAMS))
    return Table(place, rows)


@dataclass
class Model:
    langs: list[str]
    table: Table | None                     # DIMS x languages, or DIMS x landmarks before ``then``
    then: np.ndarray | None = None          # landmarks x languages
    #: Margins below these are unlike nearly all of the language's training texts.
    least_margin: dict[str, float] = field(default_factory=dict)

    def scores(self, texts: list[list[np.ndarray]]) -> np.ndarray:
        """Regression values (texts x languages)."""
        x = self.table.project(texts)
        return x if self.then is None else x @ self.then


def nystroem(table: Table, marks: list[list[np.ndarray]]) -> np.ndarray:
    """K_mm^(-1/2), up to a rotation: landmarks x features."""
    gram = table.project(marks)
    val, vec = np.linalg.eigh((gram + gram.T) / 2)
    good = val > 1e-8 * max(val.max(), 1e-300)
    return vec[:, good] / np.sqrt(val[good])


def solve(table: Table, root: np.ndarray, normal: np.ndarray, sums: dict[str, tuple[int, np.ndarray]], ridge: float) -> Model:
    """One-versus-rest ridge regressions from the normal matrix and each language's number of
    texts and sum of features; targets +1 and -1, less their mean."""
    names = sorted(sums)
    n = np.array([sums[x][0] for x in names], np.float64)
    each = np.stack([sums[x][1] for x in names], 1)
    whole = each.sum(1, keepdims=True)
    right = 2 * each - whole - whole * (2 * n / n.sum() - 1)
    then = root @ np.linalg.solve(normal + ridge * np.eye(len(normal)), right)
    if len(names) < table.columns:
        return Model(names, Table(table.place, (table.rows @ then).astype(np.float32)))
    return Model(names, table, then)


def margins(values: np.ndarray) -> np.ndarray:
    """Best value less the second best; infinite with one language."""
    if values.shape[1] < 2:
        return np.full(len(values), np.inf)
    two = np.partition(values, -2, axis=1)
    return two[:, -1] - two[:, -2]


def training_sample(docs: DataFrame, held_out: Column, per_lang: int) -> DataFrame:
    """(lang, doc_id, turn, grams): at most ``per_lang`` texts with a letter of each language, of
    the smallest hashes of their id, numbered from 1. The cut is taken within hashed shares of
    a language first, so however many rows it has, no task gathers them."""
    ok = docs.filter(~held_out & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # An id given to several rows of a language is one text: the one of the smallest hash.
    ids = ok.groupBy("lang", "doc_id").agg(F.min(F.xxhash64("text")).alias("h"))
    for shares in (*SHARES, 1):
        order = Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shares))).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= per_lang)
    ids = stored(ids, "lang-ids")
    # Few ids are broadcast, so texts are not shuffled.
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    rows = (ok.select("lang", "doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(ids) if few else ids, ["lang", "doc_id", "h"])
            .groupBy("lang", "doc_id").agg(F.min("turn").alias("turn"), F.min("text").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for b in batches for p in slices(b)):
            grams = [presence(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array([[g.tolist() for g in t] for t in grams], pa.list_(pa.list_(pa.int32())))],
                ["lang", "doc_id", "turn", "grams"])

    return stored(rows.select("lang", "doc_id", "text", "turn").mapInArrow(run, "lang string, doc_id long, turn int, grams array<array<int>>"), "lang-sample")


def _texts(column: pa.Array) -> list[list[np.ndarray]]:
    return [[np.array(g, np.int64) for g in t] for t in column.to_pylist()]


def train(docs: DataFrame, held_out: Column, per_lang: int = 300, landmarks: int = 256, ridge: float = 0.1) -> Model:
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sample = training_sample(src, held_out, per_lang)
    # The first texts of all languages in turn.
    first = sample.orderBy("turn", F.xxhash64("lang"), "lang").limit(landmarks).collect()
    if not first:
        return Model([], None)
    marks = [[np.array(g, np.int64) for g in r.grams] for r in first]
    table = landmark_table(marks)
    root = nystroem(table, marks)
    sent = docs.sparkSession.sparkContext.broadcast((table, root))  # bounded: DIMS x landmarks

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, root = sent.value
        normal, per = np.zeros((root.shape[1],) * 2), {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                phi = table.project(_texts(part.column(1))) @ root
                normal += phi.T @ phi
                langs = np.array(part.column(0).to_pylist(), object)
                for lang in set(langs.tolist()):
                    n, total = per.get(lang, (0, 0.0))
                    here = phi[langs == lang]
                    per[lang] = (n + len(here), total + here.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array([None, *per], pa.string()), pa.array([0, *(n for n, _ in per.values())], pa.int64()),
                                          pa.array([normal.tobytes(), *(t.tobytes() for _, t in per.values())], pa.binary())], ["lang", "n", "sums"])

    tasks = max(1, -(-sample.count() // FIT_TEXTS))
    normal, per = 0.0, {}
    for r in sample.select("lang", "grams").coalesce(tasks).mapInArrow(sums, "lang string, n long, sums binary").toLocalIterator():
        x = np.frombuffer(r.sums)
        if r.lang is None:
            normal = normal + x.reshape((root.shape[1],) * 2)
        else:
            n, total = per.get(r.lang, (0, 0.0))
            per[r.lang] = (n + r.n, total + x)
    model = solve(table, root, normal, per, ridge)
    model.least_margin = least_margins(sample, model)
    return model


def least_margins(sample: DataFrame, model: Model, share: float = 0.01) -> dict[str, float]:
    """Per language, a quarter of the margin that all but ``share`` of its rightly told training texts reach."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                values = m.scores(_texts(part.column(1)))
                right = [m.langs[c] == lang for c, lang in zip(values.argmax(1), part.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(right, margins(values), np.nan), from_pandas=True)], ["lang", "margin"])

    told = sample.select("lang", "grams").mapInArrow(run, "lang string, margin double")
    return {r.lang: r.m / 4 for r in told.groupBy("lang").agg(F.percentile_approx("margin", share, 1000).alias("m")).collect() if r.m is not None}


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred, score, and sure: whether the margin is as large as nearly all
    training texts of that language have it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: DIMS x landmarks, and landmarks x languages
    src, at = with_text(docs, keep)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("sure", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (p for b in batches for p in slices(b)):
            pred, score, sure = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            texts = [t.as_py() for t in b.column(at)]
            rows = [i for i, t in enumerate(texts) if m.langs and has_letter(t)]
            if rows:
                values = m.scores([presence(texts[i]) for i in rows])
                e = np.exp(4 * (values - values.max(1, keepdims=True)))
                for i, c, s, margin in zip(rows, values.argmax(1), e.max(1) / e.sum(1), margins(values)):
                    pred[i], score[i] = m.langs[c], s
                    sure[i] = margin >= m.least_margin.get(m.langs[c], 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(pred, pa.string()), pa.array(score), pa.array(sure)], [*keep, "lang_pred", "score", "sure"])

    return src.mapInArrow(run, schema)


def language_id(docs: DataFrame, modulus: int = 5, remainder: int = 0, **fitting) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from documents whose crc32 of the
    id mod ``modulus`` is not ``remainder``."""
    held_out = in_fold("doc_id", modulus, remainder)
    model = train(docs, held_out, **fitting)
    return (predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))

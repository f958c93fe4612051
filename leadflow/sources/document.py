"""One large JSON document ``{stage: [records]}`` read by many tasks.

A JSON parser must start at the beginning of a document; a task that reads a byte range does not know
whether it starts inside a string, or how deep. Both are prefix sums, so the document is read
twice:

1. Every split counts its unescaped quotes and its brackets, the latter for both guesses (outside and
   inside a string). One small row a split comes back; added up in order they give
   each split its true start.
2. Every split cuts the records out of its text and notes the stage names it meets. What a split's
   edges cut apart (a record, rarely a stage name) comes out as fragments, at most two a split besides
   splits that lie wholly inside one record, and is put together afterwards.

Spark's text source does the splitting: records are delimited by ``}``, which ends every
object, so a record without nested objects is one line of it. A brace inside a string is no
problem, as the quotes are counted; an escape never crosses a ``}``. A folder of part files, in the
order of their names, is one document too: so :func:`leadflow.sinks.session.write_document` writes it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r'\\.|["{}\[\]]', re.S)
#: Depth of a stage name (inside the document) and between the records of its array.
NAME_DEPTH, LIST_DEPTH = 1, 2
RECORD, NAME = "record", "name"
OUT = "split long, pos long, kind string, open boolean, close boolean, stage string, text string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    m = F.col("_metadata")
    return (spark.read.option("lineSep", "}").text(path)
            .select("value", F.element_at(F.split(m["file_path"], "/"), -1).alias("file"), m["file_block_start"].alias("start"),
                    ((m["file_block_start"] + m["file_block_length"]) >= m["file_size"]).alias("last")))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """Texts of each split with their closing braces back, in order, as ((file, start), texts). The
    text after the last brace of a file has none."""
    def rows():
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())

    it = rows()
    ahead = next(it, None)

    def texts(key):
        nonlocal ahead
        while ahead is not None and (ahead[1], ahead[2]) == key:
            value, _, _, last = ahead
            ahead = next(it, None)
            end_of_file = last and (ahead is None or (ahead[1], ahead[2]) != key)
            yield value if end_of_file and not value.strip() else value + "}"

    while ahead is not None:
        key = (ahead[1], ahead[2])
        split = texts(key)
        yield key, split
        for _ in split:
            pass


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, odd quotes?, depth if it starts outside a string, depth if inside)."""
    for (file, start), texts in _splits(batches):
        inside, depth = 0, [0, 0]
        for text in texts:
            for token in _TOKEN.findall(text):
                if token == '"':
                    inside ^= 1
                elif token in "{[":
                    depth[inside] += 1
                elif token in "}]":
                    depth[inside] -= 1
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), pa.array([inside], pa.int64()),
                                          pa.array([depth[0]], pa.int64()), pa.array([depth[1]], pa.int64())],
                                         ["file", "start", "odd", "outside", "inside"])


def cut_records(texts: Iterator[str], inside: bool, depth: int) -> Iterator[tuple]:
    """(kind, opened here?, closed here?, stage so far, text) of each record, and of stage names cut by an
    edge; whole names only set the stage."""
    stage = None
    kind = NAME if depth == NAME_DEPTH and inside else RECORD if depth > LIST_DEPTH else None
    opened, held = False, []
    for text in texts:
        begin = 0
        for m in _TOKEN.finditer(text):
            token, at = m.group(), m.start()
            if token == '"':
                inside = not inside
                if depth == NAME_DEPTH and inside:
                    kind, opened, begin = NAME, True, at
                elif depth == NAME_DEPTH:
                    held.append(text[begin:at + 1])
                    if opened:
                        stage = json.loads("".join(held))
                    else:
                        yield NAME, False, True, stage, "".join(held)
                    kind, held = None, []
            elif inside:
                continue
            elif token in "{[":
                if depth == LIST_DEPTH:
                    kind, opened, begin = RECORD, True, at
                depth += 1
            elif token in "}]":
                depth -= 1
                if depth == LIST_DEPTH and kind == RECORD:
                    held.append(text[begin:at + 1])
                    yield RECORD, opened, True, stage, "".join(held)
                    kind, held = None, []
        if kind is not None:
            held.append(text[begin:])
    if kind is not None:
        yield kind, opened, False, stage, "".join(held)
    yield "end", False, False, stage, None


def read_document(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """``(stage, *record)`` of the document at ``path`` (a file, or a folder of its parts). Spark's
    ``spark.sql.files.maxPartitionBytes`` is the size of a split. A record is gathered in
    one task, however long; a document that is not of this form gives the records that are."""
    pieces = _pieces(spark, path)
    counts = pieces.mapInArrow(_count, "file string, start long, odd long, outside long, inside long").collect()
    starts, inside, depth = {}, 0, 0
    for i, r in enumerate(sorted(counts, key=lambda r: (r.file, r.start))):
        starts[r.file, r.start] = (i, bool(inside), depth)
        depth += r.inside if inside else r.outside
        inside ^= r.odd

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in OUT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
        for key, texts in _splits(batches):
            number, within, level = starts[key]
            rows, size = [], 0
            for pos, row in enumerate(cut_records(texts, within, level)):
                rows.append((number, pos, *row))
                size += len(row[-1] or "")
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    rows = pieces.mapInArrow(cut, OUT)
    # Fragments and stages: a few rows a split, so one window may hold them.
    order = Window.orderBy("split", "pos")
    bits = rows.filter((F.col("kind") != "end") & ~(F.col("open") & F.col("close")))
    grouped = bits.withColumn("_g", F.sum(F.col("open").cast("int")).over(order))
    joined = (grouped.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("split", "pos", "text", "kind", "close", "stage"))).alias("parts"))
              .select(F.element_at("parts", -1)["split"].alias("split"), F.col("parts")[0]["split"].alias("first"), F.col("parts")[0]["kind"].alias("kind"),
                      F.col("parts")[0]["stage"].alias("stage"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")))
    # The stage at a split's start: the last one met before. In order of split come the name that ends at
    # its edge (0), the place its first rows look back from (1), and its last whole name (2).
    ends = rows.filter((F.col("kind") == "end") & F.col("stage").isNotNull()).select("split", F.lit(2).alias("step"), "stage")
    cut_name = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>")[0]
    cut_names = joined.filter(F.col("kind") == NAME).select("split", F.lit(0).alias("step"), cut_name.alias("stage"))
    here = rows.filter(F.col("kind") == "end").select("split", F.lit(1).alias("step"), F.lit(None).cast("string").alias("stage"))
    before = Window.orderBy("split", "step").rowsBetween(Window.unboundedPreceding, 0)
    opening = (ends.unionByName(cut_names).unionByName(here).withColumn("_opening", F.last("stage", ignorenulls=True).over(before))
               .filter("step = 1").select("split", "_opening"))
    whole = rows.filter((F.col("kind") == RECORD) & F.col("open") & F.col("close")).select("split", "stage", "text")
    parts = joined.filter(F.col("kind") == RECORD).select(F.col("first").alias("split"), "stage", "text")
    found = whole.unionByName(parts).join(opening, "split", "left").select(F.coalesce("stage", "_opening").alias("stage"), F.from_json("text", record).alias("r"))
    return found.select("stage", "r.*")

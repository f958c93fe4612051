"""A refresh's outputs published as one run, in files of even size.

:func:`publish_session` writes the combined CSV, the CSVs by stage, the JSON lines by stage and the
``{stage: [records]}`` document of a refresh through :mod:`leadflow.sinks.publish`: readers see
all of a session or the one before.

Output sizing: rows are dealt with Spark's ``REBALANCE`` hint. Adaptive execution measures the shuffled
partitions and splits or merges them towards a byte target, also within a stage that holds most rows
(and merges the small stages' tasks), so the number of files follows the data, not a
constant. The unit of a split is what one task of the input has for a stage: files below that
size need more input tasks.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.session import cut_lineage
from leadflow.sinks.publish import latest_run, publish, run_folder
from leadflow.sinks.writers import TIMES, _nested_to_json, run_stamp

FILE_BYTES = 128 << 20
#: Bytes of CSV or JSON text per byte that Spark shuffles of the same rows (compressed), measured on leads.
TEXT_PER_SHUFFLED = 2.5


@contextmanager
def file_size(spark: SparkSession, target: int) -> Iterator[None]:
    """While open, rebalanced writes aim at files of ``target`` bytes of text."""
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(max(1, int(target / TEXT_PER_SHUFFLED))),
                "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b",
                "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rebalanced(df: DataFrame, *by: str) -> DataFrame:
    return df.hint("rebalance", *[F.col(c) for c in by])


#: Number of a stored row.
ROW_ID = "_session_row"


def session_rows(leads: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``leads`` dealt by stage towards files of ``file_bytes`` of text, numbered (``ROW_ID``) and stored: the
    outputs of a session are written from it without another shuffle, a file for each of its own."""
    with file_size(leads.sparkSession, file_bytes):
        return cut_lineage(rebalanced(leads.withColumn(ROW_ID, F.monotonically_increasing_id()), "stage"), "session-rows")


@contextmanager
def file_by_file(spark: SparkSession) -> Iterator[None]:
    """While open, a scan has a task for each file (files above Spark's split size are split)."""
    before = spark.conf.get("spark.sql.files.openCostInBytes", None)
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes", "128MB"))
        yield
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes") if before is None else spark.conf.set("spark.sql.files.openCostInBytes", before)


#: First records of at most this many stages are broadcast.
MAX_BROADCAST_STAGES = 1000


def write_document(leads: DataFrame, path: str, order: Sequence[str | Column], stage: str = "stage", partitions: int | None = None) -> str:
    """The rows as one JSON document ``{stage: [records]}`` in ordered parts: the files of ``path``,
    put one after the other by name, are the document (``cat part-* > document.json``), written by as many
    tasks as there are ranges. Stages come in the order of their names, records by ``order``; rows
    without a stage are left out, as no name can hold them. Stored rows bring their own number (``ROW_ID``)."""
    spark = leads.sparkSession
    numbered = ROW_ID in leads.columns
    rows = leads.filter(F.col(stage).isNotNull())
    record = F.to_json(F.struct(*[F.col(c) for c in leads.columns if c not in (stage, ROW_ID)]), {**TIMES, "ignoreNullFields": "false"})
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = rows.select(F.col(stage).alias("_stage"), record.alias("_record"), F.struct(*keys).alias("_at"),
                       (F.col(ROW_ID) if numbered else F.monotonically_increasing_id()).alias("_id"))
    if not numbered:
        rows = cut_lineage(rows, "document-rows")   # its numbers are used twice: to find a stage's first record, and to place it
    first = rows.groupBy("_stage").agg(F.min(F.struct("_at", "_id")).alias("_first"))
    stages = [r[0] for r in first.select("_stage").orderBy("_stage").limit(1).collect()]    # the document's first stage
    name = F.expr("substring(to_json(array(_stage)), 2, length(to_json(array(_stage))) - 2)")
    lead = F.concat(F.when(F.col("_stage") == F.lit(stages[0] if stages else ""), "{").otherwise("],"), name, F.lit(":["))
    is_first = F.struct("_at", "_id") == F.col("_first")
    few = first.limit(MAX_BROADCAST_STAGES + 1).count() <= MAX_BROADCAST_STAGES
    lines = rows.join(F.broadcast(first) if few else first, "_stage").select("_stage", "_at", "_id", F.concat(F.when(is_first, lead).otherwise(","), "_record").alias("value"))
    end = spark.range(1).select(F.lit(None).cast("string").alias("_stage"), F.lit(None).cast(rows.schema["_at"].dataType).alias("_at"),
                                F.lit(None).cast("long").alias("_id"), F.lit("]}" if stages else "{}").alias("value"))
    place = [F.col("_stage").asc_nulls_last(), F.col("_at"), F.col("_id")]
    placed = lines.unionByName(end)
    placed = placed.repartitionByRange(partitions, *place) if partitions else placed.repartitionByRange(*place)
    placed.sortWithinPartitions(*place).select("value").write.text(path)
    return path


def publish_session(leads: DataFrame, root: str, ts: _dt.datetime, file_bytes: int = FILE_BYTES, order: Sequence[str] = ("item_id",)) -> str:
    """Publishes one refresh, of rows as they are or of `session_rows`; returns its run name."""
    spark = leads.sparkSession
    run = f"{run_stamp(ts)}-{uuid.uuid4().hex[:8]}"       # a second try is a run of its own
    stored = leads if ROW_ID in leads.columns else session_rows(leads, file_bytes)
    rows = stored.drop(ROW_ID)
    flat = _nested_to_json(rows)

    def document(path: str) -> None:
        with file_size(spark, file_bytes):
            write_document(stored, path, order)

    with file_by_file(spark):
        publish(spark, root, run, {
            "combined": lambda p: flat.write.options(**TIMES).option("header", True).csv(p),
            "stages": lambda p: flat.write.options(**TIMES).option("header", True).partitionBy("stage").csv(p),
            "grouped": lambda p: rows.write.options(**TIMES).option("ignoreNullFields", False).partitionBy("stage").json(p),
            "document": document,
        }, ts)
    return run


def session_path(spark: SparkSession, root: str, dataset: str, run: str | None = None) -> str:
    """Where a dataset of the newest published session (or of ``run``) lies."""
    return f"{run_folder(root, run or latest_run(spark, root))}/{dataset}"


def read_session_csv(spark: SparkSession, root: str, dataset: str, schema: T.StructType | str, run: str | None = None) -> DataFrame:
    """A CSV dataset of a published session, ``''`` read as null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(session_path(spark, root, dataset, run))

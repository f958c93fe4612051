"""Snapshot and export writers.

Every writer is a distributed ``DataFrameWriter`` call: tasks write their
own files in parallel, nothing is gathered on the driver. Run stamps and
stages become directory partitions (``run=<ts>/stage=<name>``) so readers
prune them.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.session import literal_table

RUN_FORMAT = "%Y%m%d_%H%M%S"
#: Texts of timestamps keep their microseconds (Spark writes milliseconds by default).
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def run_stamp(ts: _dt.datetime) -> str:
    return ts.strftime(RUN_FORMAT)


def _nested_to_json(df: DataFrame) -> DataFrame:
    """CSV cannot hold nested values: arrays, maps and structs become JSON text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name), TIMES).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_combined_csv(leads: DataFrame, root: str, ts: _dt.datetime) -> str:
    """All leads as one run-stamped CSV dataset with header."""
    path = f"{root.rstrip('/')}/combined/run={run_stamp(ts)}"
    _nested_to_json(leads).write.mode("overwrite").options(**TIMES).option("header", True).csv(path)
    return path


def write_stage_csvs(leads: DataFrame, root: str, ts: _dt.datetime) -> str:
    """Per-stage CSVs of the current session; the previous session is replaced in place
    (:func:`leadflow.sinks.session.publish_session` keeps it readable until the new one is whole).

    Rows are dealt by stage; adaptive execution splits a large stage and merges small ones by size."""
    path = f"{root.rstrip('/')}/session"
    (_nested_to_json(leads).withColumn("run", F.lit(run_stamp(ts))).hint("rebalance", F.col("stage"))
        .write.mode("overwrite").options(**TIMES).option("header", True).partitionBy("stage", "run").csv(path))
    return path


def write_grouped_json(leads: DataFrame, root: str, ts: _dt.datetime) -> str:
    """Stage-grouped JSON snapshot as JSON lines partitioned by stage.

    (A single ``{stage: [records]}`` document would funnel every record
    through one writer; the partitioned layout is read back by
    :func:`leadflow.sources.snapshots.read_grouped_json`.)
    """
    path = f"{root.rstrip('/')}/grouped/run={run_stamp(ts)}"
    (leads.hint("rebalance", F.col("stage"))
        .write.mode("overwrite").options(**TIMES).option("ignoreNullFields", False).partitionBy("stage").json(path))
    return path


#: Offsets, one row a partition, are broadcast up to this many partitions.
MAX_BROADCAST_PARTITIONS = 100_000


def chunk_index(df: DataFrame, order_cols, size: int) -> DataFrame:
    """Adds ``_row`` (0-based position in ``order_cols`` order), ``chunk_number``
    (1-based: consecutive runs of ``size`` rows) and ``total_rows``.

    Rows are numbered inside the partitions of a range-sorted, checkpointed
    frame; a small table of one row a partition gives each its offset.
    """
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    srt = df.orderBy(*order_cols).withColumn("_pid", F.spark_partition_id()).checkpoint()
    counts = srt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("total_rows"))
    if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) <= MAX_BROADCAST_PARTITIONS:
        off = F.broadcast(off)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return (srt.withColumn("_local", local).join(off, "_pid")
            .withColumn("_row", F.col("_off") + F.col("_local"))
            .withColumn("chunk_number", (F.floor(F.col("_row") / size) + 1).cast("long"))
            .drop("_pid", "_off", "_local"))


def write_chunked_json(df: DataFrame, base: str, order_cols, size: int = 10000,
                       ts: _dt.datetime | None = None, records: str = "invitees") -> tuple[str, str]:
    """One file per chunk of ``size`` records in ``order_cols`` order: a JSON document
    of the ``records`` and their ``metadata`` (chunk number, number of chunks, chunk
    size, total, extraction time, base name); and a manifest dataset
    ``(chunk_number, total_chunks, chunk_size)``. Returns (data path, manifest path).

    A chunk is gathered into one row, of ``size`` records at most. Spark names the
    files; which chunk one holds is in its metadata.
    """
    base = base.rstrip("/")
    row = F.struct("_row", F.struct(*df.columns).alias("r"))
    per = (chunk_index(df, order_cols, size).groupBy("chunk_number")
           .agg(F.collect_list(row).alias("rows"), F.first("total_rows").alias("total")))
    in_order = F.array_sort("rows", lambda x, y: (x["_row"] - y["_row"]).cast("int"))
    metadata = F.struct("chunk_number", F.ceil(F.col("total") / size).cast("long").alias("total_chunks"),
                        F.size("rows").cast("long").alias("chunk_size"), F.col("total").alias(f"total_{records}"),
                        F.lit(ts.isoformat() if ts else None).cast("string").alias("extraction_timestamp"),
                        F.lit(base.rsplit("/", 1)[-1]).alias("base_filename"))
    data, manifest = f"{base}/chunks", f"{base}/manifest"
    docs = per.select(F.transform(in_order, lambda x: x["r"]).alias(records), metadata.alias("metadata"))
    docs.write.mode("overwrite").options(**TIMES).option("maxRecordsPerFile", 1).option("ignoreNullFields", False).json(data)
    (df.sparkSession.read.schema(docs.select("metadata").schema).json(data)
       .select("metadata.chunk_number", "metadata.chunk_size", "metadata.total_chunks")
       .write.mode("overwrite").options(**TIMES).json(manifest))
    return data, manifest


def export_formats(df: DataFrame, base: str, formats=("csv", "parquet")) -> dict:
    """CSV (nested values as JSON text) and snappy Parquet exports."""
    out = {}
    for fmt in formats:
        path = f"{base.rstrip('/')}/{fmt}"
        if fmt == "csv":
            _nested_to_json(df).write.mode("overwrite").options(**TIMES).option("header", True).csv(path)
        elif fmt == "parquet":
            df.write.mode("overwrite").options(**TIMES).option("compression", "snappy").parquet(path)
        elif fmt == "json":
            df.write.mode("overwrite").options(**TIMES).json(path)
        else:
            raise ValueError(f"unsupported format {fmt}")
        out[fmt] = path
    return out


ENTITY_KINDS = ("events", "invitees", "members")


def export_entity_csv(kind: str, df: DataFrame, base: str) -> str:
    """Entity CSV export (``events`` = org + user types, ``invitees``,
    ``members``) of all columns; nested columns go out as JSON text."""
    if kind not in ENTITY_KINDS:
        raise ValueError(f"unknown entity kind {kind!r}")
    path = f"{base.rstrip('/')}/{kind}"
    _nested_to_json(df).write.mode("overwrite").options(**TIMES).option("header", True).csv(path)
    return path


def export_members_json(members: DataFrame, base: str, ts: _dt.datetime,
                        organization_uri: str | None = None) -> tuple[str, str]:
    """Members as JSON lines plus a one-row metadata document
    (extraction time, organization, member count)."""
    data = f"{base.rstrip('/')}/members"
    members.write.mode("overwrite").options(**TIMES).json(data)
    meta = members.agg(F.count(F.lit(1)).alias("total_members")).select(
        F.struct(F.lit(ts.isoformat()).alias("extraction_timestamp"),
                 F.lit(organization_uri).cast("string").alias("organization_uri"),
                 F.col("total_members")).alias("metadata"))
    mpath = f"{base.rstrip('/')}/metadata"
    meta.write.mode("overwrite").options(**TIMES).json(mpath)
    return data, mpath


def export_profile_json(profile: DataFrame, base: str, ts: _dt.datetime) -> str:
    """User profile rows as JSON documents ``{metadata, user}`` (one per
    profile row: extraction time and organization id beside the profile)."""
    from leadflow.functions.columns import uri_tail
    path = f"{base.rstrip('/')}/profile"
    org = uri_tail("current_organization") if "current_organization" in profile.columns else F.lit(None)
    doc = profile.select(
        F.struct(F.lit(ts.isoformat()).alias("extraction_timestamp"),
                 org.cast("string").alias("organization_id")).alias("metadata"),
        F.struct(*[F.col(c) for c in profile.columns]).alias("user"))
    doc.write.mode("overwrite").options(**TIMES).json(path)
    return path


def extraction_manifest(parts: dict, ts: _dt.datetime, base: str) -> tuple[str, DataFrame]:
    """Run summary document: per-part row counts (empty parts count 0), timestamp
    and success, which is written once all parts could be read.

    ``parts`` maps a part name to a DataFrame; the counts are one
    aggregate over the union of the parts (one job).
    """
    frames = [df.select(F.lit(name).alias("part")) for name, df in parts.items()]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    names = literal_table(frames[0].sparkSession, [(n,) for n in parts], "part string")
    counts = (names.join(u.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part", "left")   # an empty part counts 0
                   .select("part", F.coalesce("n", F.lit(0)).cast("long").alias("records")))
    doc = counts.agg(F.map_from_entries(F.collect_list(F.struct("part", "records"))).alias("summary")).select(
        F.lit(ts.isoformat()).alias("timestamp"), "summary",
        F.lit(True).alias("success"))
    path = f"{base.rstrip('/')}/manifest"
    doc.write.mode("overwrite").options(**TIMES).json(path)
    return path, doc

"""Readers for written snapshots: grouped JSON, CSV, newest files, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.functions.columns import RUN_FILE_RE
from leadflow.session import literal_table


def read_grouped_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Stage-partitioned JSON lines snapshot -> rows with ``stage``."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_grouped_document(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """A ``{stage: [records]}`` document (one per file) -> rows with ``stage``."""
    schema = T.MapType(T.StringType(), T.ArrayType(record))
    doc = spark.read.option("multiLine", True).schema(
        T.StructType([T.StructField("value", T.StringType())])).text(path, wholetext=True)
    m = doc.select(F.from_json("value", schema).alias("m"))
    e = m.select(F.explode("m").alias("stage", "records"))
    return e.select("stage", F.explode("records").alias("r")).select("stage", "r.*")


def read_snapshot_csv(spark: SparkSession, path: str, stage: str | None = None,
                      schema: T.StructType | None = None) -> DataFrame:
    """Combined or per-stage CSV snapshot (``''`` read as null); a stage
    argument prunes the partition directories."""
    r = spark.read.option("header", True).option("nullValue", "")
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(path)
    if stage is not None:
        df = df.filter(F.col("stage") == F.lit(stage))
    return df


def file_listing(spark: SparkSession, glob: str) -> DataFrame:
    """File path, size and modification time without reading contents."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob)
                 .select("path", "length", "modificationTime"))


RUN_DIR_FAMILY_RE = r"([^/]+)/run=\d{8}_\d{6}(/|$)"
RUN_DIR_STAMP_RE = r"run=(\d{8}_\d{6})"
FILE_FAMILY_RE = r"([^/]*?)_\d{8}_\d{6}[^/]*$"


def latest_snapshot(spark: SparkSession, glob: str, family_re: str = RUN_DIR_FAMILY_RE,
                    stamp_re: str = RUN_DIR_STAMP_RE) -> DataFrame:
    """Per snapshot family, the newest run by modification time: its path, name,
    total size of all its files, number of files, newest modification time, and the
    run timestamp parsed from its path.

    Defaults read this library's ``<family>/run=<yyyyMMdd_HHmmss>/`` layout, where a
    run is a folder; ``family_re=FILE_FAMILY_RE, stamp_re=RUN_FILE_RE`` read flat
    ``<family>_<stamp>.csv`` names, where it is a file.
    """
    folder = F.regexp_extract("path", r"^(.*/run=\d{8}_\d{6})(?:/|$)", 1)
    f = (file_listing(spark, glob).withColumn("family", F.regexp_extract("path", family_re, 1)).filter("family <> ''")
              .withColumn("_stamp", F.nullif(F.regexp_extract("path", stamp_re, 1), F.lit("")))
              .withColumn("path", F.when(folder == "", F.col("path")).otherwise(folder)))
    runs = f.groupBy("family", "path", "_stamp").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("files"),
                                                     F.max("modificationTime").alias("modificationTime"))
    best = runs.groupBy("family").agg(F.max_by(F.struct("path", "length", "files", "modificationTime", "_stamp"),
                                               F.struct("modificationTime", "_stamp", "path")).alias("b"))
    return best.select("family", "b.path", F.element_at(F.split("b.path", "/"), -1).alias("file_name"), "b.length", "b.files",
                       "b.modificationTime", F.try_to_timestamp(F.col("b._stamp"), F.lit("yyyyMMdd_HHmmss")).alias("run_timestamp"))


def latest_flat_snapshot(spark: SparkSession, glob: str) -> DataFrame:
    """:func:`latest_snapshot` for flat ``<family>_<yyyyMMdd_HHmmss>.<ext>``
    file names (e.g. ``combined_output_20240102_030405.csv``)."""
    return latest_snapshot(spark, glob, FILE_FAMILY_RE, RUN_FILE_RE)


def snapshot_status(spark: SparkSession, glob: str, families) -> DataFrame:
    """Per expected family: exists, name of the newest run, its size in KB (2 dp),
    modified."""
    latest = latest_snapshot(spark, glob)
    exp = literal_table(spark, [(x,) for x in families], "family string")
    j = F.broadcast(exp).join(latest, "family", "left")
    return j.select("family", F.col("path").isNotNull().alias("exists"), "file_name",
                    F.round(F.col("length") / 1024.0, 2).alias("size_kb"),
                    F.col("modificationTime").alias("modified"))


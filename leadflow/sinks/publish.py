"""Publication of runs that readers see whole or not at all.

A run writes its datasets under ``<root>/runs/<run>/<dataset>``, a folder no earlier run
uses. Only when all are written does its *commit* appear: a small JSON dataset of one file
under ``<root>/commits/run=<run>``, with a row per dataset (files, bytes, runs it replaces).
Readers list the commits and read what they name, so a write that dies half-way leaves
nothing a reader would look at, and the runs before it stay as they are. Nothing is renamed,
overwritten or deleted, which holds on object stores too; a second writer has a run
name of its own.
"""

from __future__ import annotations

import datetime as _dt
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT_SCHEMA = "dataset string, files long, bytes long, replaces array<string>, published_at string, run string"
_RUN_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


def run_folder(root: str, run: str) -> str:
    return f"{root.rstrip('/')}/runs/{run}"


def file_sizes(spark: SparkSession, path: str) -> tuple[int, int]:
    """(files, bytes) of a written dataset, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return n, size


def publish(spark: SparkSession, root: str, run: str, writers: Mapping[str, Callable[[str], None]],
            at: _dt.datetime, replaces: Sequence[str] = ()) -> str:
    """Writes each dataset by calling ``writers[name](path)``, then the commit. Returns the run's folder.

    An error in a writer goes to the caller; the run stays uncommitted. ``replaces``: runs
    that readers shall leave out from this commit on (a compaction).
    """
    if not _RUN_NAME.fullmatch(run):
        raise ValueError(f"run name {run!r}: letters, digits, _, . and - only")
    if run in {r for (r,) in commits(spark, root).select("run").distinct().collect()}:
        raise ValueError(f"run {run} is already published")
    folder = run_folder(root, run)
    rows = []
    for name, write in writers.items():
        write(f"{folder}/{name}")
        rows.append((name, *file_sizes(spark, f"{folder}/{name}")))
    entries = F.array(*[F.struct(F.lit(n).alias("dataset"), F.lit(f).cast("long").alias("files"), F.lit(b).cast("long").alias("bytes"),
                                 F.array(*[F.lit(r) for r in replaces]).cast("array<string>").alias("replaces"),
                                 F.lit(at.isoformat()).alias("published_at")) for n, f, b in rows])
    (spark.range(1).coalesce(1).select(F.inline(entries))
     .write.mode("errorifexists").json(f"{root.rstrip('/')}/commits/run={run}"))
    return folder


def commits(spark: SparkSession, root: str) -> DataFrame:
    """One row per dataset of every published run; none where nothing is published yet."""
    path = f"{root.rstrip('/')}/commits"
    try:
        return spark.read.schema(COMMIT_SCHEMA).option("basePath", path).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT_SCHEMA)


def live_runs(spark: SparkSession, root: str) -> list[str]:
    """Published runs that no published run replaces, oldest first. One name a run comes to the driver."""
    seen = commits(spark, root).groupBy("run").agg(F.max("published_at").alias("at"), F.flatten(F.collect_set("replaces")).alias("old")).collect()
    replaced = {r for row in seen for r in row.old or []}
    return [row.run for row in sorted(seen, key=lambda r: (r.at, r.run)) if row.run not in replaced]


def latest_run(spark: SparkSession, root: str) -> str:
    runs = live_runs(spark, root)
    if not runs:
        raise FileNotFoundError(f"nothing is published under {root}")
    return runs[-1]


def unfinished(spark: SparkSession, root: str, run: str) -> dict[str, tuple[int, int]]:
    """Datasets of a published run whose files no longer are what its commit says:
    name -> (files, bytes) found. Empty for an intact run."""
    out = {}
    for r in commits(spark, root).filter(F.col("run") == run).collect():
        found = file_sizes(spark, f"{run_folder(root, run)}/{r.dataset}")
        if found != (r.files, r.bytes):
            out[r.dataset] = found
    return out

"""Shared pieces of the llm operators: table reading, scratch tables, word rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.session import scratch_path

# The word rule of the contracts, `[^\x20\x09-\x0D]+`, as a Java / Python pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: work done once,
    lineage cut, and safe against lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    for paths in _NOTED:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_NOTED: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders of the tables that `stored` writes meanwhile, in order."""
    paths: list[str] = []
    _NOTED.append(paths)
    try:
        yield paths
    finally:
        _NOTED[:] = [x for x in _NOTED if x is not paths]


def release(spark: SparkSession, paths: Sequence[str]) -> None:
    """Deletes scratch tables that nothing reads any more."""
    sc = spark.sparkContext
    for p in paths:
        folder = sc._jvm.org.apache.hadoop.fs.Path(p)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that what is made of it leaves the worker, and reaches the JVM, bit by bit."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def with_text(docs: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, int]:
    """``keep`` columns and the text as a string, with the text's place: texts that are kept as
    they are go to the workers once."""
    keep = list(keep)
    if "text" in keep and docs.schema["text"].dataType.simpleString() == "string":
        return docs.select(*keep), keep.index("text")
    return docs.select(*keep, F.col("text").cast("string").alias("_text")), len(keep)


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: ``bytes.split()`` splits at exactly 09-0D and 20."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As `words`, with A-Z (only) lower-cased, as ``bytes.lower`` does."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def id_crc(doc_id: str | Column) -> Column:
    """crc32 of an id written as decimal text; null stays null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string"))


def in_fold(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """True where crc32(id as text) mod ``modulus`` is ``remainder``; null ids: false."""
    return F.coalesce(F.pmod(id_crc(doc_id), F.lit(modulus)) == remainder, F.lit(False))

"""What the corpus operators share: shared storage for intermediate tables and a few expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: blank, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a Python worker turns to at once; whole texts can be long, so few.
ARROW_ROWS = 256

_own_dir: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; where that is unset and all runs in one process, as in tests, a temporary one."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]


def clear_stored() -> int:
    """Delete the intermediate tables that this process has written, once no result that reads them is needed any more. Returns how many there were."""
    n = len(_written)
    for spark, path in _written:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.clear()
    return n


def stored(df: DataFrame, name: str, partition_by: str | None = None, arrow_rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: its lineage is cut, and lost executors lose nothing of it.

    arrow_rows: how many rows go to a Python worker at once during this write alone; the session's setting comes back after it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append((df.sparkSession, path))
    writer = df.write.option("compression", "zstd")
    writer = writer.partitionBy(partition_by) if partition_by else writer
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = df.sparkSession.conf.get(limit)
    df.sparkSession.conf.set(limit, arrow_rows or before)
    try:
        writer.parquet(path)
    finally:
        df.sparkSession.conf.set(limit, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ARROW_ROWS at a time. Spark bounds a batch by its bytes; what is made of its texts is bounded by these slices."""
    for b in batches:
        for at in range(0, b.num_rows, ARROW_ROWS):
            yield b.slice(at, ARROW_ROWS)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def local_rows(spark: SparkSession, rows_json: str, schema: str) -> DataFrame:
    """A small table from JSON text, made by Spark's own functions alone."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(rows_json), f"array<struct<{schema}>>")).alias("r")).select("r.*")

"""Tables written between passes: their lineage is cut, and lost executors lose nothing of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a folder of our own only where it is unset and all runs in one process, as in tests."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-"))
    return _own[0]


def narrowed(df: DataFrame, *columns: str, name: str = "rows") -> DataFrame:
    """These columns alone, worked out once for all passes that follow."""
    return stored(df.select(*dict.fromkeys(columns)), name)


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

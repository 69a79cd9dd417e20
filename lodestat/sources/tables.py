"""Reading raw text tables, keeping them as Parquet, and writing results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: How a text file is to be read: its encoding, and whether a quoted field of it holds line ends.
UTF_8, LATIN_1 = "UTF-8", "ISO-8859-1"


def text_form(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(encoding, whether records span lines), from one pass over the bytes of all lines, which Spark splits freely.

    Lines that are not valid UTF-8 make a file Latin-1; a U+FFFD that is there as such does not. A line with an odd
    number of quotes begins or ends inside a quoted field.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    bad, odd = spark.read.text(path).agg(F.max(~F.is_valid_utf8("value")), F.max(quotes % 2)).first()
    return LATIN_1 if bad else UTF_8, bool(odd)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """The named columns as text; a header tells where they are. Files that are not UTF-8 are read as Latin-1.

    Files whose records are lines are split over tasks; one with line ends inside quotes is read whole by a task each.
    """
    encoding, spans = text_form(spark, path)
    plain = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", spans).option("encoding", encoding)
    df = plain.csv(path).select(*columns)
    return df if limit is None else df.limit(limit)


def read_exact(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A result table as it was written: only empty fields are null, ``NA`` and ``None`` are labels, doubles are exact."""
    return spark.read.option("header", True).option("nullValue", "").option("escape", '"').schema(schema).csv(path)


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return bool(fs.exists(p))


def read_optional(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """An empty table of that schema where there is no file."""
    return read_exact(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_defaults(spark: SparkSession, path: str, names: Mapping[str, str]) -> DataFrame:
    """Named columns of a reference table under new names, in the order of names."""
    return read_csv(spark, path, list(names)).select(*[F.col(a).alias(b) for a, b in names.items()])


def cached(spark: SparkSession, source: str, cache_dir: str, build, refresh: bool = False) -> DataFrame:  # noqa: ANN001
    """build() written as Parquet under a name made of the source's path, size and time; older ones of this path go.

    A folder without the writer's success mark is the rest of a failed write and is made again.
    """
    fs, p = _hadoop(spark, source)
    s = fs.getFileStatus(p)
    prefix = hashlib.md5(source.encode()).hexdigest()
    name = f"{prefix}-{s.getLen()}-{s.getModificationTime()}"
    out = f"{cache_dir.rstrip('/')}/{name}"
    if refresh or not exists(spark, f"{out}/_SUCCESS"):
        build().write.mode("overwrite").parquet(out)
    cfs, c = _hadoop(spark, cache_dir)
    for f in cfs.listStatus(c):
        old = f.getPath().getName()
        if old.startswith(f"{prefix}-") and old != name:
            cfs.delete(f.getPath(), True)
    return spark.read.parquet(out)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = (), one_file: bool = False) -> None:
    """Doubles are written in the shortest form that reads back the same. One file is for result tables alone."""
    out = df.select(*[F.col(c).cast("string").alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    if order:
        out = df.sort(*order).select(*[F.col(c).cast("string").alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(spark: SparkSession, value: Mapping, path: str, data_source: str) -> None:
    """A nested summary, with where its data come from."""
    fs, p = _hadoop(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(json.dumps({"data_source": data_source, **value}, indent=2, default=str).encode()))
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])

"""Readers over any file system that Spark reads: files of values, tables and frames."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import mapped
from ..operators import frames
from ..operators.tables import tab_decode
from ..plans.schema import Schema
from .. import values


_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share, deleted when the session's process ends. Only where all run in one process may the cluster's setting be missing."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner clears it
            return


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: a row a file, whole (UTF-8)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_values(spark: SparkSession, path: str, schema: Schema | None = None) -> DataFrame:
    """``path, kind, json, canon``: files that hold a value, a value after directives, or a patch."""
    d = read_texts(spark, path)
    kind = F.when(F.ltrim("text").startswith("@patch"), "patch").when(F.ltrim("text").startswith("@tab"), "table").otherwise("value")
    json = mapped(lambda s: values.to_json(values.parse(s, schema=schema)))(F.col("text"))
    canon = mapped(lambda s: values.loose(values.parse(s, schema=schema)))(F.col("text"))
    d = d.withColumn("kind", kind)
    return d.select("path", "kind", F.when(F.col("kind") != "patch", json).alias("json"), F.when(F.col("kind") != "patch", canon).alias("canon"), "text")


def read_tables(spark: SparkSession, path: str, fields: T.StructType, schema: Schema | None = None) -> DataFrame:
    """Rows of table files, typed; ``path`` and ``pos`` say where each lay."""
    return tab_decode(read_texts(spark, path), "text", fields, schema)


def read_frames(spark: SparkSession, path: str, **how) -> DataFrame:
    """Frames of binary files. A file cannot be split, so files are the parallelism."""
    return frames.decode(spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("raw")), "raw", **how)


def stream_frames(spark: SparkSession, path: str, **how) -> DataFrame:
    """As ``read_frames``, of files as they arrive."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return frames.decode(raw.select("path", F.col("content").alias("raw")), "raw", **how)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A text column, one value a line. Values of several lines (tables) stay whole."""
    df.select(F.col(column).alias("value")).write.text(path)

"""Append-only logs: one canonical record per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of stage events and diagnostics.
EVENTS = "sequence long, run_id string, stage string, document_id string, event string, outcome string, wall_clock string, resource_counters map<string,string>"


class LogError(ValueError):
    """A log that isn't whole."""


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a finished log. The last line of each file must be ended and every line be an object
    of the schema's fields; a line that isn't fails the read. Of a file only the last byte is looked at."""
    for r in spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length").collect():
        if last_byte(spark, r["path"], r["length"]) != 0x0A:
            raise LogError(f"unterminated line in {path}")
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def last_byte(spark: SparkSession, path: str, length: int) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        stream.seek(length - 1)
        return stream.read()
    finally:
        stream.close()


def write(lines: DataFrame, path: str, order: str = "sequence", line: str = "line", files: int = 1) -> None:
    """Rendered lines in order, to one file or to several whose names are in order; an existing log
    isn't overwritten."""
    dealt = lines.coalesce(1) if files == 1 else lines.repartitionByRange(files, order)
    dealt.sortWithinPartitions(order).select(F.col(line).alias("value")).write.mode("errorifexists").text(path)


def stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The same records as they arrive in a folder."""
    return spark.readStream.schema(schema).json(folder)

"""JSON that keeps arriving, with the types that inference found in what has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.infer import build_table
from tessera.sources.records import from_file


def known_schema(spark: SparkSession, folder: str) -> T.StructType:
    """The lossless schema of the JSON Lines that a folder holds now."""
    return build_table(from_file(spark, folder if folder.endswith((".jsonl", ".ndjson")) else f"{folder.rstrip('/')}/*.jsonl")).df.schema


def typed_stream(spark: SparkSession, folder: str, schema: T.StructType, max_files: int = 100) -> DataFrame:
    """A stream of a folder's JSON Lines as typed rows.

    A line that doesn't fit the schema isn't lost: its fields are null and its text stands in _unread, so that it can be
    read again with a wider schema. Lines that fit have a null there.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).where(F.trim("value") != "")
    wide = T.StructType([*schema.fields, T.StructField("_unread", T.StringType())])
    rows = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"}).alias("r"))
    return rows.select("r.*")


def windowed_counts(events: DataFrame, time_col: str, key_col: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key and window of event time; state is dropped once the watermark has passed a window."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, window), F.col(key_col)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key_col, "n")

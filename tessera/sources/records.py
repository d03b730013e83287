"""From any JSON source to a DataFrame of records: one row of JSON text for each row of the later table."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import json_text as J

#: Files of at least this size are read and split by executors; smaller ones by the driver.
STREAM_MIN_BYTES = 4 * 1024 * 1024


@dataclass
class Records:
    """raw: (rec_id long, raw string). root: array, object or scalar, as the source's root is. size: bytes, if known."""

    raw: DataFrame
    root: str
    source: str
    size: int | None = None


def _root_of(value: Any) -> str:
    return "array" if isinstance(value, list) else "object" if isinstance(value, dict) else "scalar"


def _bytes(texts: list[str]) -> int:
    return sum(len(t) if t.isascii() else 4 * len(t) for t in texts)


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    table = pa.table({"rec_id": pa.array(range(len(texts)), pa.int64()), "raw": pa.array(texts, pa.string())})
    return spark.createDataFrame(table)  # Spark deals local rows out to all cores


def from_value(spark: SparkSession, value: Any, source: str = "memory") -> Records:
    root = _root_of(value)
    texts = [J.dumps(x) for x in value] if root == "array" else [J.dumps(value)]
    for t in texts if root == "array" else ():
        if "NaN" in t or "Infinity" in t:
            J.loads(t)
    return Records(from_texts(spark, texts), root, source, _bytes(texts))


def from_text(spark: SparkSession, text: str | bytes, path: str | None = None, source: str = "json_string") -> Records:
    if path is None and J.is_array_text(text):
        texts = list(J.element_texts(text))
        return Records(from_texts(spark, texts), "array", source, _bytes(texts))
    return from_value(spark, J.walk_path(J.loads(text), path), source)


def file_size(spark: SparkSession, file: str) -> int:
    """The bytes of a file, or of all files of a folder or pattern, in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.globStatus(where) or []
    if not len(found):
        raise FileNotFoundError(f"no such file: {file}")
    return sum(store.getContentSummary(one.getPath()).getLength() for one in found)


def _content(spark: SparkSession, file: str, characters: int | None = None) -> str:
    """The text of a file, or its beginning: opened here if it is a local one, else read by Spark."""
    if "://" not in file and os.path.isfile(file):
        with open(file, "rb") as f:
            return f.read(characters if characters else -1).decode("utf-8-sig", "strict" if characters is None else "ignore")
    text = F.col("value") if characters is None else F.substring("value", 1, characters)
    rows = spark.read.text(file, wholetext=True).select(text).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{file} isn't one file: a folder can hold JSON Lines only (.jsonl, .ndjson)")
    return rows[0][0].removeprefix("\ufeff")


def from_file(spark: SparkSession, file: str, path: str | None = None, stream_min_bytes: int = STREAM_MIN_BYTES) -> Records:
    """A JSON document in a file of any store that Spark reads, or JSON Lines.

    A large root array, and a large document of which a path takes a part, are split on an executor, element by
    element. One document is one text for any reader, so its split is one task and it can't be over 2 GB; its records
    are dealt out at once after it. JSON Lines (.jsonl, .ndjson) and folders of it are split by Spark and scale with the
    file.
    """
    name = file.rstrip("/").lower()
    if name.endswith((".jsonl", ".ndjson")):
        if path is not None:
            raise ValueError("a path needs one document; JSON Lines are many")
        lines = spark.read.text(file).where(F.trim("value") != "")
        return Records(lines.select(F.monotonically_increasing_id().alias("rec_id"), F.col("value").alias("raw")), "array", file, file_size(spark, file))
    size = file_size(spark, file)
    if size < stream_min_bytes or path is None and not J.is_array_text(_content(spark, file, 4096)):
        return from_text(spark, _content(spark, file), path, file)

    def batch(n: int, rows: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(n, n + len(rows)), pa.int64()), pa.array(rows, pa.string())], names=["rec_id", "raw"])

    def split(batches):
        for part in batches:
            for text in part.column(0):
                n, rows = 0, []
                if path is None:
                    found = J.element_texts(text.as_py())
                else:  # the part alone leaves the executor
                    value = J.walk_path(J.loads(text.as_py().removeprefix("\ufeff")), path)
                    found = map(J.dumps, value) if isinstance(value, list) else [J.dumps(value)]
                for element in found:
                    rows.append(element)
                    if len(rows) == 2048:
                        yield batch(n, rows)
                        n, rows = n + len(rows), []
                if rows:
                    yield batch(n, rows)

    whole = spark.read.text(file, wholetext=True)
    root = "array" if path is None else whole.mapInArrow(_root_at(path), "root string").first()["root"]
    raw = whole.mapInArrow(split, "rec_id long, raw string").repartition(max(2, spark.sparkContext.defaultParallelism))
    return Records(raw, root, file, size)


def _root_at(path: str):
    def run(batches):
        for part in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_root_of(J.walk_path(J.loads(x.as_py().removeprefix("\ufeff")), path)) for x in part.column(0)], pa.string())], names=["root"])

    return run


def load(spark: SparkSession, source: Any, path: str | None = None, stream_min_bytes: int = STREAM_MIN_BYTES) -> Records:
    """For register(): a dict or list, JSON text that begins with a brace or bracket, or else a file."""
    if isinstance(source, (dict, list)):
        return from_value(spark, J.walk_path(source, path))
    if isinstance(source, (str, Path)):
        text = str(source)
        if J.first_mark(text) in ("{", "["):
            return from_text(spark, text, path)
        return from_file(spark, text, path, stream_min_bytes)
    raise TypeError(f"unsupported source type: {type(source)}")


def load_any(spark: SparkSession, source: Any) -> Records:
    """For analyze(): also lists of JSON texts and scalar texts; an existing file goes before JSON text."""
    if isinstance(source, dict):
        return from_value(spark, source, "dict")
    if isinstance(source, list):
        if source and isinstance(source[0], str):
            for text in source:
                J.loads(text)
            return Records(from_texts(spark, list(source)), "array", "json_strings", _bytes(source))
        return from_value(spark, source, "list")
    if isinstance(source, Path):
        out = from_file(spark, str(source))
        return Records(out.raw, out.root, "file", out.size)
    if isinstance(source, str):
        if os.path.exists(source) or "://" in source and J.first_mark(source) not in ("{", "[", '"'):
            out = from_file(spark, source)
            return Records(out.raw, out.root, "file", out.size)
        try:
            return from_text(spark, source)
        except J.InvalidJson as error:
            if J.first_mark(source) in ("{", "["):
                raise
            raise ValueError(f"neither JSON nor a file: {source!r}") from error
    raise TypeError(f"unsupported source type: {type(source)}")


def from_column(df: DataFrame, column: str, source: str = "column") -> Records:
    """Records of a string column of JSON text; null rows are left out.

    Records are numbered by their place in the plan's partitions; samples are the same again where that is.
    """
    return Records(df.where(F.col(column).isNotNull()).select(F.monotonically_increasing_id().alias("rec_id"), F.col(column).alias("raw")), "array", source)

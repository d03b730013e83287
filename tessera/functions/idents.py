"""Identifiers of Spark SQL: when they need backticks, and which are valid table names."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import SparkSession

_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Fixed value: ISO 8601 dates and times as JSON services write them.
ISO_DATE = re.compile(r"\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?")


@lru_cache(maxsize=1)
def _reserved() -> frozenset[str]:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("a running Spark session is needed to know its keywords")
    strict = spark.newSession()  # only there does the list tell which words the standard reserves
    for key in ("spark.sql.ansi.enabled", "spark.sql.ansi.enforceReservedKeywords"):
        strict.conf.set(key, "true")
    return frozenset(r[0].lower() for r in strict.sql("SELECT keyword FROM sql_keywords() WHERE reserved").collect())


def is_plain(name: str) -> bool:
    return _PLAIN.fullmatch(name) is not None


def quote(name: str) -> str:
    """The name as Spark SQL has to spell it: in backticks only if it isn't plain or is reserved by the standard."""
    if is_plain(name) and name.lower() not in _reserved():
        return name
    return "`" + name.replace("`", "``") + "`"


def quote_path(path: str) -> str:
    return ".".join(quote(p) for p in path.split("."))


def check_table_name(name: str) -> str:
    if not isinstance(name, str) or not is_plain(name):
        raise ValueError(f"invalid table name {name!r}: letters, digits and underscores are allowed, and no digit first")
    return name


def singular(table: str) -> str:
    return table[:-1] if table.lower().endswith("s") else table

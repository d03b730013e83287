"""Lossless schema inference and typed tables: every record and key is seen, conflicts become text."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.facts import ITEM, Facts, collect_facts
from tessera.sources.records import Records

DEFAULT_MAX_DEPTH = 64
_FAMILY = {"int": "number", "float": "number", "bool": "bool", "str": "str", "object": "object", "array": "array"}
_STRICT = {"mode": "FAILFAST", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _hazard(raw: Column) -> Column:
    """What Spark's own inference would lose or change: empty objects, integers over 18 digits, numbers that are no strict JSON."""
    return raw.rlike(r"\{\s*\}") | raw.rlike(r"(?<![.0-9])[0-9]{19}") | raw.contains("NaN") | raw.contains("Infinity")


def resolve(facts: Facts, path: tuple[str, ...] = (), depth: int = DEFAULT_MAX_DEPTH) -> T.DataType:
    """The type of the values at path. No kind but null: text. Two families: text. Containers below depth: text."""
    kinds = {k for k in facts.at(path) if k != "null"}
    families = {_FAMILY[k] for k in kinds}
    if len(families) != 1:
        return T.StringType()
    family = families.pop()
    if family == "number":
        if "float" in kinds:
            return T.DoubleType()
        return T.StringType() if facts.at(path)["int"]["big"] else T.LongType()
    if family == "bool":
        return T.BooleanType()
    if family == "str" or depth <= 0:
        return T.StringType()
    if family == "object":
        fields = [T.StructField(k, resolve(facts, (*path, "." + k), depth - 1)) for k in facts.keys(path)]
        return T.StructType(fields) if fields else T.StringType()
    if (*path, ITEM) not in facts.cells:
        return T.ArrayType(T.StringType())
    return T.ArrayType(resolve(facts, (*path, ITEM), depth - 1))


@dataclass
class Table:
    """df: the typed rows. wrapped: rows aren't objects, so they stand in one column called value."""

    df: DataFrame
    wrapped: bool
    n_rows: int
    facts: Facts | None = None


def _clean_schema(records: Records, max_depth: int) -> tuple[T.StructType | None, int]:
    """Spark's own inference, which runs in the JVM, if nothing in the records is beyond it, else None; and how many there are."""
    if records.root != "array":
        return None, 1
    quick = records.raw.agg(
        F.count("raw").alias("n"),
        F.bool_or(_hazard(F.col("raw"))).alias("hazard"),
        F.bool_and(F.col("raw").rlike(r"^\s*(\{|null\s*$)")).alias("objects"),
        F.bool_or(F.col("raw").rlike(r"^\s*\{")).alias("some"),
    ).first()
    if quick["hazard"] or not quick["objects"] or not quick["some"]:
        return None, quick["n"]
    # In a session of its own, so that no other query sees names told apart by case.
    strict = records.raw.sparkSession.newSession()
    strict.conf.set("spark.sql.caseSensitive", "true")
    rows = strict._jvm.org.apache.spark.sql.classic.Dataset.ofRows(strict._jsparkSession, records.raw.select("raw")._jdf.queryExecution().logical())
    reader = strict._jsparkSession.read().options(_STRICT)
    texts = getattr(rows, "as")(strict._jvm.org.apache.spark.sql.Encoders.STRING())
    found = T.StructType.fromJson(json.loads(reader.json(texts).schema().json()))
    return (found if _depth(found) <= max_depth and _plain(found) else None), quick["n"]


def _depth(kind: T.DataType) -> int:
    if isinstance(kind, T.StructType):
        return 1 + max((_depth(f.dataType) for f in kind.fields), default=0)
    if isinstance(kind, T.ArrayType):
        return 1 + _depth(kind.elementType)
    return 0


def _distinct_names(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return len({f.name.lower() for f in kind.fields}) == len(kind.fields) and all(_distinct_names(f.dataType) for f in kind.fields)
    return _distinct_names(kind.elementType) if isinstance(kind, T.ArrayType) else True


def _plain(kind: T.DataType) -> bool:
    """Only types of the inferred model, and no keys that differ in case alone."""
    if isinstance(kind, T.StructType):
        return len({f.name.lower() for f in kind.fields}) == len(kind.fields) > 0 and all(_plain(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType)
    return isinstance(kind, (T.LongType, T.DoubleType, T.BooleanType, T.StringType))


def _parse(raw: DataFrame, schema: T.StructType) -> DataFrame:
    if not _distinct_names(schema):  # keys that differ in case alone are columns of their own, for this session from now on
        raw.sparkSession.conf.set("spark.sql.caseSensitive", "true")
    text = F.when(~F.col("raw").rlike(r"^\s*null\s*$"), F.col("raw"))
    return raw.select("rec_id", F.from_json(text, schema, _STRICT | {"maxNestingDepth": "2000"}).alias("r"))


def build_table(records: Records, max_depth: int = DEFAULT_MAX_DEPTH, facts: Facts | None = None) -> Table:
    """The typed table of some records.

    An object root is one row; objects (and nulls, as rows of nulls) give a column for each key, sorted by name. All
    else, and objects that are always empty, gives one column called value. No records: no rows, value of text.
    """
    spark = records.raw.sparkSession
    if records.root == "scalar":
        raise ValueError("a table needs a JSON object or array, not a scalar")
    schema, n = _clean_schema(records, max_depth) if facts is None else (None, 0)
    if schema is None:
        facts = facts or collect_facts(records.raw)
        n = sum(c["n"] for c in facts.at(()).values())
        kinds = set(facts.at(()))
        if not kinds:
            return Table(spark.createDataFrame([], "value string"), True, 0, facts)
        resolved = resolve(facts, (), max_depth)
        if isinstance(resolved, T.StructType) and "object" in kinds:
            schema = resolved
        else:
            # Under a key, every value keeps its text where types conflict.
            wrapped = F.concat(F.lit('{"value":'), F.col("raw"), F.lit("}"))
            rows = _parse(records.raw.withColumn("raw", wrapped), T.StructType([T.StructField("value", resolved)]))
            return Table(rows.select("r.value"), True, n, facts)
    rows = _parse(records.raw, schema)
    return Table(rows.select(*[F.col("r").getField(f.name).alias(f.name) for f in schema.fields]), False, n, facts)

"""SQL over registered JSON: guarded, with limits of time and size, and prompts that describe the tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from itertools import islice
from pathlib import Path
from typing import Any
from uuid import uuid4

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.idents import check_table_name, quote
from tessera.operators.facts import Facts, collect_facts
from tessera.operators.infer import DEFAULT_MAX_DEPTH, build_table
from tessera.operators.structure import Samples, Shape, frame_shape, print_schema, root_shape
from tessera.plans.dialect import texts, tokens
from tessera.plans.guard import Guard, ReadOnlyViolationError, ResultTooLargeError, SecurityConfig, in_time
from tessera.plans.prompt import build_prompt
from tessera.plans.result_size import can_be_large, passes_on, result_bytes
from tessera.plans.table_text import check_format, table_text
from tessera.sources.records import STREAM_MIN_BYTES, Records, load

#: Headings by which readers of a description find its parts.
TABLES_HEADING, COLUMNS_HEADING = "## Available Tables", ("| Column | Type |", "|--------|------|")
#: Structure is shown down to this depth.
SHOWN_DEPTH = 32
#: Rows of a frame whose values a prompt shows.
SHOWN_ROWS = 1000
#: Sources up to so many bytes of JSON are kept as text and as typed rows while the engine is open.
KEEP_BYTES = 2 << 30


_READERS = {
    "read_csv": lambda reader, path: reader.csv(path, header=True, inferSchema=True), "read_csv_auto": lambda reader, path: reader.csv(path, header=True, inferSchema=True),
    "read_json": lambda reader, path: reader.json(path, multiLine=True), "read_json_auto": lambda reader, path: reader.json(path, multiLine=True),
    "read_text": lambda reader, path: reader.text(path, wholetext=True).withColumnRenamed("value", "content"), "read_parquet": lambda reader, path: reader.parquet(path),
}


@dataclass
class QueryResult:
    """A result for a tool: markdown on success, else the error's text."""

    success: bool
    sql: str
    markdown: str
    error: str | None = None
    row_count: int = 0
    preview: str | None = None


class RegisteredTable(dict):
    """What is known of a table; its facts are collected when something first asks for them."""

    def __init__(self, records: Records | None, **known: Any):
        super().__init__(known)
        self.records, self._facts, self._shape = records, None, None

    @property
    def facts(self) -> Facts:
        if self._facts is None:
            self._facts = collect_facts(self.records.raw)
        return self._facts

    @property
    def shape(self) -> Shape | None:
        if self.records is None or self.get("value_wrapped"):
            return None
        if self._shape is None:
            if self.get("fields") is not None:
                self.facts.complete = False  # these are the first rows, not all
                self._shape = frame_shape(self["fields"], self.facts, self["row_count"], SHOWN_DEPTH)
            else:
                self._shape = root_shape(self.facts, self.records.root, self["row_count"], SHOWN_DEPTH)
        return self._shape


def start_session(config: SecurityConfig) -> SparkSession:
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC")
    if SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{config.threads or '*'}]")
        if config.memory_limit:
            builder = builder.config("spark.driver.memory", config.memory_limit.lower().replace("gb", "g").replace("mb", "m"))
    return builder.getOrCreate()


class QueryEngine:
    """Tables from JSON, and SQL over them, in a Spark session of their own."""

    def __init__(self, security: SecurityConfig | None = None, *, spark: SparkSession | None = None, max_depth: int = DEFAULT_MAX_DEPTH, stream_min_bytes: int = STREAM_MIN_BYTES, keep_bytes: int = KEEP_BYTES, dialect: str = "spark", **overrides: Any):
        """dialect: spark, or compat for queries with unnest, QUALIFY, 1-based indexes and NULLS LAST by default.

        overrides: fields of SecurityConfig; they are ignored where security is given.
        """
        if dialect not in ("spark", "compat"):
            raise ValueError(f"unknown dialect {dialect!r}: use spark or compat")
        self.dialect = dialect
        self.security = security or replace(SecurityConfig(), **overrides)
        self.spark = (spark or start_session(self.security)).newSession()
        for key, value in {
            "spark.sql.ansi.enabled": "true",
            "spark.sql.ansi.doubleQuotedIdentifiers": "true",
            "spark.sql.ansi.enforceReservedKeywords": str(dialect == "spark").lower(),
            "spark.sql.runSQLOnFiles": str(self.security.allow_external_access).lower(),
            "spark.sql.session.timeZone": "UTC",
            # Rows from memory become partitions: as part of a plan they would be compared whenever a cached plan is sought.
            "spark.sql.execution.arrow.localRelationThreshold": "1m",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.debug.maxToStringFields": "2000",
        }.items():
            self.spark.conf.set(key, value)
        self.max_depth, self.stream_min_bytes, self.keep_bytes = max_depth, stream_min_bytes, keep_bytes
        self.tables: dict[str, RegisteredTable] = {}
        self.guard = Guard(self.spark, self.security, self.tables)
        self._cached: list[DataFrame] = []
        self._handed_on: dict[str, int] = {}  # what passes_on() told of a text
        self._closed = False

    # ---- tables

    def register(self, name: str, source: str | Path | dict | list, path: str | None = None, description: str | None = None) -> QueryEngine:
        """Make a JSON source a table; path goes to a part of it, as in $.catalog.products."""
        check_table_name(name)
        return self.register_records(name, load(self.spark, source, path, self.stream_min_bytes), path, description)

    def register_records(self, name: str, records: Records, path: str | None = None, description: str | None = None) -> QueryEngine:
        check_table_name(name)
        if records.root == "scalar":
            raise ValueError("a table needs a JSON object or array")
        raw = records.raw if records.raw.sparkSession is self.spark else self._adopt(records.raw)
        # Records are read for inference, for the rows and for the facts, and rows by every query. Where the source is
        # small enough both are kept, on disk where memory is short; a larger one is read again.
        small = records.size is not None and records.size <= self.keep_bytes
        records = replace(records, raw=raw.persist(StorageLevel.MEMORY_AND_DISK) if small else raw)
        table = build_table(records, self.max_depth)
        rows = table.df.persist(StorageLevel.MEMORY_AND_DISK) if small else table.df
        self._cached += [records.raw, rows] if small else []
        self._publish(name, rows, records, source=records.source, path=path, row_count=table.n_rows, value_wrapped=table.wrapped, description=description, bytes=records.size)
        self.tables[name]._facts = table.facts
        return self

    def register_df(self, name: str, df: DataFrame, description: str | None = None) -> QueryEngine:
        """A DataFrame of any source as a table; nothing is read until a query does. Its session can be another one."""
        check_table_name(name)
        self._publish_frame(name, self._adopt(df), "dataframe", description)
        return self

    def _publish_frame(self, name: str, df: DataFrame, source: str, description: str | None) -> None:
        """Prompts show the schema of the frame and values of its first SHOWN_ROWS rows, read when they are first asked for."""
        head = df.limit(SHOWN_ROWS).select(F.monotonically_increasing_id().alias("rec_id"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("raw"))
        records = Records(head, "array", source) if df.columns and len(set(map(str.lower, df.columns))) == len(df.columns) else None
        self._publish(name, df, records, source=source, path=None, row_count=None, value_wrapped=records is None, description=description, bytes=None, fields=df.schema)

    def _adopt(self, df: DataFrame) -> DataFrame:
        """The same plan in the engine's own session."""
        rows = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.queryExecution().logical())
        return DataFrame(rows, self.spark)

    def register_parquet(self, name: str, path: str, description: str | None = None) -> QueryEngine:
        check_table_name(name)
        self._publish_frame(name, self.spark.read.parquet(path), path, description)
        return self

    def register_many(self, tables: dict[str, Any]) -> QueryEngine:
        """{name: source} or {name: (source, path)}."""
        for name, source in tables.items():
            self.register(name, *source) if isinstance(source, tuple) else self.register(name, source)
        return self

    def _publish(self, name: str, df: DataFrame, records: Records | None, **known: Any) -> None:
        self._handed_on.clear()
        df.createOrReplaceTempView(name)
        self.tables[name] = RegisteredTable(records, columns=df.columns, types=df.dtypes, **known)

    # ---- queries

    def settings(self) -> dict[str, Any]:
        """The limits and permissions that hold, and the Spark settings of this engine's session; they can't be changed by SQL."""
        return asdict(self.security) | {"dialect": self.dialect, "time_zone": self.spark.conf.get("spark.sql.session.timeZone"), "locked": True}

    def _with_files(self, sql: str) -> str:
        """With external access, read_csv('x'), read_json('x'), read_text('x') and read_parquet('x') as views of those files."""
        if not self.security.allow_external_access:
            return sql
        items = tokens(sql)
        for at, item in enumerate(items):
            reader = _READERS.get(item.text.lower()) if item.kind == "word" else None
            if reader is None or [x.kind for x in items[at + 1 : at + 4]] != ["mark", "text", "mark"] or items[at + 1].text + items[at + 3].text != "()":
                continue
            view = f"tessera_file_{uuid4().hex}"
            reader(self.spark.read, items[at + 2].text[1:-1].replace("''", "'")).createOrReplaceTempView(view)
            items[at].text, items[at + 1].text, items[at + 2].text, items[at + 3].text = view, "", "", ""
        return "".join(x.text for x in items)

    def _plan(self, sql: str) -> DataFrame:
        """The guarded query, not yet run; of two readings the first that resolves."""
        sql = self._with_files(sql)
        readings = texts(sql) if self.dialect == "compat" else [sql]
        for last, text in enumerate(readings, 1 - len(readings)):
            self.guard.check(text)
            try:
                return self.spark.sql(text)
            except AnalysisException:
                if not last:
                    raise
        raise AssertionError("there is always a reading")

    def _fetch(self, sql: str) -> tuple[list[str], list[tuple]]:
        """Columns and rows within the limits of time, rows and bytes."""
        return in_time(self.spark, self.security.query_timeout, lambda: self._rows_within(sql))

    def _rows_within(self, sql: str) -> tuple[list[str], list[tuple]]:
        """A result whose size isn't known to be small is measured where its rows are made, and refused before it moves.

        Rows come as Arrow batches and become Python objects only after the caps are checked.
        """
        rows_cap, bytes_cap = self.security.max_result_rows, self.security.max_result_bytes
        df = self._plan(sql)
        columns = df.columns
        limited = df if len(set(columns)) == len(columns) else df.toDF(*[f"c{i}" for i in range(len(columns))])
        if rows_cap is not None:
            limited = limited.limit(rows_cap + 1)
        large = [i for i, f in enumerate(limited.schema.fields) if can_be_large(f.dataType)]
        try:
            if bytes_cap is not None and large and not self._is_small(df, sql, bytes_cap) and (size := result_bytes(limited)) > bytes_cap:
                raise ResultTooLargeError(f"{size:,} bytes, over the cap of {bytes_cap:,}: select less, raise max_result_bytes, or use query_iter()")
            table = limited.toArrow()
        except (Py4JJavaError, PySparkException) as error:
            for sign, what in (("maxResultSize", "the result is over spark.driver.maxResultSize"), ("OutOfMemoryError", "a value is larger than the memory")):
                if sign in str(error):
                    raise ResultTooLargeError(f"{what}: select less, or use query_iter()") from error
            raise
        if rows_cap is not None and table.num_rows > rows_cap:
            raise ResultTooLargeError(f"over {rows_cap:,} rows: add a LIMIT or aggregate, raise max_result_rows, or use query_iter() or query_arrow()")
        if bytes_cap is not None and sum(table.column(i).nbytes for i in large) > bytes_cap:
            raise ResultTooLargeError(f"over {bytes_cap:,} bytes: select less, raise max_result_bytes, or use query_iter()")
        return columns, list(zip(*[_values(c) for c in table.columns], strict=True)) if columns else []

    def _is_small(self, df: DataFrame, sql: str, cap: int) -> bool:
        """Whether the tables of the query are so small that what they hand on can't be over the cap."""
        sizes = [t.get("bytes") for name, t in self.tables.items() if name.lower() in sql.lower()]
        if None in sizes:
            return False
        bound = sum(sizes) * 4  # a number in a list has 8 bytes, and 2 at least in JSON
        if bound > cap:
            return False
        if sql not in self._handed_on:
            if len(self._handed_on) >= 1000:
                self._handed_on.clear()
            self._handed_on[sql] = passes_on(df)
        return 0 < self._handed_on[sql] * bound <= cap

    def query(self, sql: str) -> list[dict[str, Any]]:
        """Rows as dicts; of columns with the same name the last one stays."""
        columns, rows = self._fetch(sql)
        return [dict(zip(columns, r, strict=True)) for r in rows]

    def query_iter(self, sql: str, batch_size: int = 1000) -> Iterator[dict[str, Any]]:
        """Rows as dicts, one partition at a time and without caps. Errors of the text are raised at the call."""
        df = self._plan(sql)
        columns = df.columns

        def rows() -> Iterator[dict[str, Any]]:
            source = None

            def some() -> list[dict[str, Any]]:
                nonlocal source
                source = source or df.toLocalIterator()
                return [dict(zip(columns, map(_plain, row), strict=True)) for row in islice(source, batch_size)]

            while batch := in_time(self.spark, self.security.query_timeout, some):
                yield from batch

        return rows()

    def query_arrow(self, sql: str):
        """The result as an Arrow table, without caps."""
        return in_time(self.spark, self.security.query_timeout, lambda: self._plan(sql).toArrow())

    def execute(self, sql: str) -> DataFrame:
        """The lazy DataFrame; limits don't hold for what is done with it."""
        return self._plan(sql)

    def explain(self, sql: str) -> str:
        sql = texts(sql)[0] if self.dialect == "compat" else sql
        self.guard.check(sql)
        return "\n".join(str(r[0]) for r in self.spark.sql(f"EXPLAIN {sql}").collect())

    # ---- text

    def execute_query(self, sql: str, split: int | None = None, max_colwidth: int | None = 50) -> QueryResult:
        """Never raises: a failure is in the result. split: rows of an additional preview."""
        try:
            columns, rows = self._fetch(sql)
        except Exception as error:
            return QueryResult(False, sql, "", f"{type(error).__name__}: {error}")
        preview = table_text(columns, rows[:split], "markdown", max_colwidth) if split else None
        return QueryResult(True, sql, table_text(columns, rows, "markdown", max_colwidth), None, len(rows), preview)

    def format_query(self, sql: str, format: str = "grid", max_rows: int | None = None, max_colwidth: int | None = 50) -> str:
        check_format(format)
        try:
            columns, rows = self._fetch(sql)
        except Exception as error:
            return f"ERROR: {error}"
        return table_text(columns, rows if max_rows is None else rows[:max_rows], format, max_colwidth)

    def query_print(self, sql: str, format: str = "grid", max_rows: int | None = 20, max_colwidth: int | None = 50, title: str | None = None) -> None:
        check_format(format)
        try:
            columns, rows = self._fetch(sql)
        except Exception as error:
            print(f"ERROR: {error}")
            return
        shown = rows if max_rows is None else rows[:max_rows]
        print("\n".join([title] * bool(title) + [table_text(columns, shown, format, max_colwidth)] + [f"(showing {len(shown)} of {len(rows)} rows)"] * (len(shown) < len(rows))))

    def _rows(self, table: RegisteredTable, name: str) -> int:
        if table["row_count"] is None:
            table["row_count"] = self.spark.table(name).count()
        return table["row_count"]

    def tables_info(self) -> str:
        lines = ["Registered tables:"]
        for name, t in self.tables.items():
            lines += [f"  {name}:", f"    source: {t['source']}", *[f"    path: {t['path']}"] * bool(t["path"]), f"    rows: {self._rows(t, name):,}"]
        return "\n".join(lines)

    def schema(self, table: str) -> str:
        check_table_name(table)
        return "\n".join([f"Schema of '{table}':", *(f"  {c}: {t}" for c, t in self.spark.table(f"`{table}`").dtypes)])

    def print_tables(self) -> None:
        print(self.tables_info())

    def print_schema(self, table: str) -> None:
        print(self.schema(table))

    def describe_tables(self, samples: int | None = 3, max_sample_len: int = 60, max_schema_depth: int | None = 8, enum_max: int = 12) -> str:
        """The tables' schemas in a compact notation; tables without objects get a table of their columns."""
        lines = [TABLES_HEADING, ""]
        for name, t in self.tables.items():
            lines += [f"### `{name}` ({self._rows(t, name):,} rows)" + (f" — {t['description']}" if t["description"] else ""), ""]
            if t.shape is not None:
                lines += ["```typescript", print_schema(t.shape, Samples(t.facts, max(0, samples or 0), max_sample_len, enum_max), max_schema_depth), "```", ""]
            else:
                lines += [*COLUMNS_HEADING, *(f"| {quote(c)} | {k} |" for c, k in t["types"]), ""]
        return "\n".join(lines)

    def generate_prompt(self, samples: int | None = 3, max_sample_len: int = 60, max_schema_depth: int | None = 8, enum_max: int = 12) -> str:
        described = self.describe_tables(samples, max_sample_len, max_schema_depth, enum_max)
        return build_prompt(described, {name: t.shape for name, t in self.tables.items()})

    # ---- life

    def close(self) -> None:
        if not self._closed:
            self._closed = True
            for df in self._cached:
                df.unpersist()
            for name in self.tables:
                self.spark.catalog.dropTempView(name)
            self.tables.clear()

    def __enter__(self) -> QueryEngine:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()


def _values(column: pa.ChunkedArray) -> list:
    """Python values, column by column at every level; moments without a zone, in UTC, as Spark's rows have them."""
    return [v for chunk in column.chunks for v in _array_values(chunk)]


def _array_values(array: pa.Array) -> list:
    kind = array.type
    if pa.types.is_timestamp(kind) and kind.tz is not None:
        array = array.cast(pa.timestamp("us"))
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        out = [dict(zip(names, row, strict=True)) for row in zip(*map(_array_values, array.flatten()), strict=True)] if names else [{}] * len(array)
    elif pa.types.is_list(kind):
        flat, ends = _array_values(array.values), array.offsets.to_pylist()
        out = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    elif pa.types.is_string(kind) or not array.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return array.to_numpy(zero_copy_only=False).tolist()
    else:
        return array.to_pylist()
    return [v if ok else None for v, ok in zip(out, array.is_valid().to_pylist(), strict=True)] if array.null_count else out


def _plain(value: Any) -> Any:
    """Spark's rows as dicts, nested ones too."""
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


__all__ = ["QueryEngine", "QueryResult", "ReadOnlyViolationError", "ResultTooLargeError", "SecurityConfig"]

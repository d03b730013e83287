"""Which SQL may run: only reads of registered tables. Spark's own parser decides what a text is; doubt means no."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


class ReadOnlyViolationError(Exception):
    """The SQL isn't a plain read of registered tables."""


class ResultTooLargeError(Exception):
    """A result is over the cap of rows or bytes."""


@dataclass
class SecurityConfig:
    """What queries may do. memory_limit and threads only apply to a session that the engine starts itself."""

    allow_external_access: bool = False
    read_only: bool = True
    query_timeout: float | None = 30.0
    max_result_rows: int | None = 1_000_000
    max_result_bytes: int | None = 256 * 1024 * 1024
    memory_limit: str | None = "2g"
    threads: int | None = None
    lock_configuration: bool = True
    denied_functions: frozenset[str] = frozenset()


#: Plan nodes of reads. Everything else, known or new, is refused.
_READS = frozenset("""
Aggregate AsOfJoin Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset
OneRowRelation ParameterizedQuery Pivot Project Range Sample Sort SubqueryAlias Tail Union UnionLoop Unpivot UnresolvedGroupByAll
UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedOrdinal UnresolvedPivot UnresolvedRelation UnresolvedSubqueryColumnAliases
UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedUnpivot UnresolvedWith Window WithWindowDefinition UnresolvedJoin NaturalJoin
""".split())
#: Functions that reach code, files, settings or the host; and table functions that do.
_DENIED = frozenset("""
java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length from_avro to_avro schema_of_avro from_protobuf to_protobuf
current_catalog current_database current_schema current_user user session_user version python_worker_logs read_state_metadata read_statestore raise_error assert_true
""".split())
_TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer".split())
_WRITES = re.compile(r"(?i)^\s*(attach|detach|copy|export|import|install|load|pragma|prepare|call|insert|update|delete|merge|create|drop|alter|truncate|set|reset|use|refresh|cache|uncache|clear|analyze|add|list|execute|declare|begin|grant|revoke|vacuum|checkpoint|msck|repair|describe|desc|show)\b")


def _seq(scala_seq) -> Iterator:
    for i in range(scala_seq.size()):
        yield scala_seq.apply(i)


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _classes(node) -> Iterator:
    kind = node.getClass()
    while kind is not None:
        yield kind
        kind = kind.getSuperclass()


class Guard:
    """Checks texts for one engine. tables: the registered names, looked up at each check."""

    def __init__(self, spark: SparkSession, config: SecurityConfig, tables: dict):
        self.spark, self.config, self.tables = spark, config, tables

    def check(self, sql: str) -> None:
        self.spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(self.spark._jsparkSession)
        if ";" in sql and self._statements(sql) > 1:
            raise ReadOnlyViolationError("one statement at a time")
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except (Py4JJavaError, PySparkException) as error:
            if _WRITES.match(self._bare(sql)):
                raise ReadOnlyViolationError(f"only SELECT and EXPLAIN are allowed: {sql[:80]!r}") from error
            raise
        if _name(plan) == "ExplainCommand":
            plan = plan.logicalPlan()
        if not self.config.read_only:
            plan = self._definition(plan)
            if plan is None:
                return
        self._read(plan)

    def _definition(self, plan):
        """Beyond reads, views of this session may be made and dropped: the query of a view, or None if there is none."""
        if _name(plan) == "CreateViewCommand" and "LocalTempView" in plan.viewType().toString():
            self.tables.setdefault(plan.name().table(), {"source": "view", "path": None, "row_count": None, "description": None, "view": True})
            return plan.plan()
        if _name(plan) in ("DropView", "DropTempViewCommand"):
            return None
        return plan

    @staticmethod
    def _bare(sql: str) -> str:
        return re.sub(r"^(?:\s+|--[^\n]*\n?|/\*.*?\*/)*", "", sql, flags=re.S)

    @staticmethod
    def _statements(sql: str) -> int:
        """Statements of the text: semicolons in strings, quoted names and comments don't part any."""
        plain = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", " x ", sql, flags=re.S)
        return sum(bool(part.strip()) for part in plain.split(";"))

    def _read(self, plan) -> None:
        exact = self.spark.conf.get("spark.sql.caseSensitive") == "true"
        fold = str if exact else str.lower
        todo = [("plan", plan, frozenset(map(fold, self.tables)))]  # with the names that can be read there
        while todo:
            kind, node, names = todo.pop()
            name = _name(node)
            if kind == "expression":
                if name in ("UnresolvedFunction", "UnresolvedGenerator"):
                    parts = _seq(node.nameParts()) if name == "UnresolvedFunction" else [node.name().funcName()]
                    self._function([str(p) for p in parts], None)
                todo += [(kind, c, names) for c in _seq(node.children())]
                if any(c.getSimpleName() in ("SubqueryExpression", "PlanExpression") for c in _classes(node)):
                    todo.append(("plan", node.plan(), names))
                continue
            if name not in _READS:
                raise ReadOnlyViolationError(f"{name} is not allowed: only SELECT and EXPLAIN of registered tables are")
            if name == "UnresolvedRelation":
                parts = [str(p) for p in _seq(node.multipartIdentifier())]
                if not self.config.allow_external_access and (len(parts) != 1 or fold(parts[0]) not in names):
                    raise ReadOnlyViolationError(f"{'.'.join(parts)} is no registered table")
            if name == "UnresolvedTableValuedFunction":
                self._function([str(p) for p in _seq(node.name())], _TABLE_FUNCTIONS)
            if name == "UnresolvedWith":  # a name counts for the definitions behind its own and for the query, nowhere else
                itself = node.allowRecursion()
                for inner in _seq(node.innerChildren()):
                    own = fold(inner.alias()) if _name(inner) == "SubqueryAlias" else None
                    todo.append(("plan", inner, names | {own} if itself and own else names))
                    names = names | {own} if own else names
            else:
                todo += [("plan", inner, names) for inner in _seq(node.innerChildren())]
            todo += [("plan", c, names) for c in _seq(node.children())]
            todo += [("expression", e, names) for e in _seq(node.expressions())]

    def _function(self, parts: list[str], only: frozenset[str] | None) -> None:
        name = parts[-1].lower()
        if name in _DENIED or name in self.config.denied_functions or len(parts) > 1 or only is not None and name not in only:
            raise ReadOnlyViolationError(f"the function {'.'.join(parts)} is not allowed")


def in_time(spark: SparkSession, seconds: float | None, work: Callable[[], Any]) -> Any:
    """work(), for no longer than so many seconds; then its Spark jobs are cancelled and TimeoutError is raised.

    The work has a thread of its own, so that the limit also ends a wait for something else than a job, as for a result
    that the driver can't take. What such a thread still does is lost.
    """
    if seconds is None:
        return work()
    context, group, out = spark.sparkContext, f"tessera-{uuid4().hex}", {}

    def run() -> None:
        spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)  # the parser asks for its settings
        context.setJobGroup(group, "guarded query", interruptOnCancel=True)
        try:
            out["value"] = work()
        except BaseException as error:
            out["error"] = error

    worker = InheritableThread(target=run, daemon=True)
    worker.start()
    worker.join(seconds)
    if worker.is_alive():
        context.cancelJobGroup(group)
        worker.join(1.0)
        raise TimeoutError(f"the query took over {seconds} s and was cancelled")
    if "error" in out:
        raise out["error"]
    return out["value"]

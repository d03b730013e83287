"""tessera: a Spark-native engine for semi-structured data."""

from tessera.operators.infer import build_table, resolve
from tessera.plans.engine import QueryEngine, QueryResult
from tessera.plans.guard import ReadOnlyViolationError, ResultTooLargeError, SecurityConfig
from tessera.plans.profiler import ProfileConfig, Profiler, validate

__all__ = ["ProfileConfig", "Profiler", "QueryEngine", "QueryResult", "ReadOnlyViolationError", "ResultTooLargeError", "SecurityConfig", "build_table", "resolve", "validate"]

"""How many bytes a result has, told before any of it leaves the executors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def can_be_large(kind: T.DataType) -> bool:
    """All other types have a fixed, small size."""
    return not isinstance(kind, (T.NumericType, T.BooleanType, T.DatetimeType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.NullType))


def cell_bytes(value: Column, kind: T.DataType) -> Column:
    """The bytes of one value; 8 for each of a fixed size."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value).cast("long")
    elif isinstance(kind, T.StructType):
        size = sum((cell_bytes(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(0).cast("long"))
    elif isinstance(kind, T.ArrayType):
        if can_be_large(kind.elementType):
            size = F.aggregate(value, F.lit(0).cast("long"), lambda total, x: total + cell_bytes(x, kind.elementType) + F.lit(8))
        else:
            size = F.size(value).cast("long") * 8
    elif isinstance(kind, T.MapType):
        size = cell_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + cell_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    elif can_be_large(kind):
        size = F.octet_length(value.cast("string")).cast("long")
    else:
        return F.lit(8).cast("long")
    return F.coalesce(size, F.lit(0).cast("long"))


def result_bytes(df: DataFrame) -> int:
    """The bytes of all large columns of all rows, added up where the rows are; the driver gets one number."""
    cells = [cell_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if can_be_large(f.dataType)]
    if not cells:
        return 0
    total = sum(cells[1:], cells[0])
    return df.agg(F.sum(total.cast("decimal(38,0)")).alias("n")).first()["n"] or 0


_ROWS_ONCE = frozenset("Project Filter Sort GlobalLimit LocalLimit Offset Aggregate Window Tail InMemoryRelation LocalRelation LogicalRDD LogicalRelation".split())
_PASSED_ON = frozenset("Alias AttributeReference GetStructField Min Max First Last".split())
#: Bytes of a constant that needn't be counted.
SHORT = 64


def passes_on(df: DataFrame) -> int:
    """How often the result can hold the bytes of the one table that it comes from, 0 if nothing tells.

    Where each large column of the result is a column or field of that table, and each of the table's rows comes at most
    once, that is once, and once more for each large column that got a name of its own.
    """
    plan, times = df._jdf.queryExecution().optimizedPlan(), 1
    while True:
        if plan.getClass().getSimpleName() not in _ROWS_ONCE:
            return 0
        for e in _seq(plan.expressions()):
            if _large_from(e):
                return 0
            times += e.getClass().getSimpleName() == "Alias" and e.resolved() and _is_large(e.dataType())
        if plan.children().isEmpty():
            return times
        if plan.children().size() > 1:
            return 0
        plan = plan.children().head()


def _is_large(kind) -> bool:
    return kind.getClass().getSimpleName().rstrip("$") in ("StringType", "BinaryType", "ArrayType", "StructType", "MapType", "VariantType", "CharType", "VarcharType")


def _large_from(expression) -> bool:
    """Whether a large value is made here, and not just handed on."""
    todo = [expression]
    while todo:
        e = todo.pop()
        name = e.getClass().getSimpleName()
        if name in ("SortOrder", "AggregateExpression", "WindowExpression", "WindowSpecDefinition", "Count"):
            todo += _seq(e.children())
            continue
        if not e.resolved() or name == "SpecifiedWindowFrame":
            continue
        kind = e.dataType()
        if name == "Literal" and kind.typeName() == "string" and (e.value() is None or e.value().numBytes() <= SHORT):
            continue
        if _is_large(kind) and name not in _PASSED_ON:
            return True
        todo += _seq(e.children())
    return False


def _seq(scala_seq) -> Iterator:
    return (scala_seq.apply(i) for i in range(scala_seq.size()))

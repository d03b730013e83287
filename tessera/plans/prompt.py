"""A prompt from which a language model can write Spark SQL over the registered tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessera.functions.idents import quote, quote_path, singular
from tessera.operators.structure import Shape


@dataclass
class Fields:
    """The top fields of a table: primitives with their type, objects, and arrays with the kind of their items."""

    flat: list[tuple[str, str]] = field(default_factory=list)
    nested: list[str] = field(default_factory=list)
    arrays: list[tuple[str, str]] = field(default_factory=list)
    ids: list[tuple[str, str]] = field(default_factory=list)  # of nested objects, one level down


def record_shape(shape: Shape) -> Shape | None:
    """The shape of a table's rows: that of the objects in a root array, or of a root object."""
    if shape.fields is not None:
        return shape
    return shape.item if shape.item is not None and shape.item.fields is not None else None


def _kind(shape: Shape) -> str | None:
    return next((p for p in shape.primitives if p != "null"), None)


def fields_of(shape: Shape | None) -> Fields:
    out = Fields()
    for name, s in (shape.fields or {}).items() if shape else ():
        if s.is_array:
            kinds = [k for k in s.items if k != "null"]
            out.arrays.append((name, "object" if "object" in kinds else kinds[0] if kinds else "str"))
        elif s.fields:
            out.nested.append(name)
            out.ids += [(f"{name}.{k}", _kind(c)) for k, c in s.fields.items() if _kind(c) and (k.lower() == "id" or k.lower().endswith("_id"))]
        elif _kind(s):
            out.flat.append((name, _kind(s)))
    return out


def join_keys(tables: dict[str, Fields]) -> list[tuple[str, str, str, str]]:
    """(table, field, table, field) that can be joined: the same type, and the same name in _id or id with <table>_id."""
    found = []
    names = list(tables)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            for f, kind in tables[a].flat + tables[a].ids:
                for g, other in tables[b].flat + tables[b].ids:
                    x, y = f.split(".")[-1].lower(), g.split(".")[-1].lower()
                    same = x == y and x.endswith("_id")
                    named = x == "id" and y == f"{singular(a).lower()}_id" or y == "id" and x == f"{singular(b).lower()}_id"
                    if kind == other and (same or named):
                        found.append((a, f, b, g))
    return found


def build_prompt(described: str, tables: dict[str, Shape | None]) -> str:
    """Rules, notation, examples over the given tables and fields, mistakes to avoid, and the tables' schemas."""
    own = {t: fields_of(record_shape(s) if s else None) for t, s in tables.items()}
    lines = ["You write Spark SQL. Turn a request for data into one query over the tables below.", "", "RULES:"]
    lines += ["- Answer with the SQL text only: no explanation, no code fence.", "- One SELECT statement; CTEs are fine. Nothing that writes, sets or defines.", "- Use only the tables and fields shown, spelled as shown, backticks included.", "- Write NULLS LAST after ORDER BY keys that can be null.", ""]
    lines += ["## Notation", "`name: type` is a field. `type?` can be null. `{...}` is a struct, `[...]` an array, `a | b` means values of both kinds, kept as text."]
    if "samples=[" in described:
        lines.append("`samples=[...]` are values that occur.")
    if "one of [" in described:
        lines.append("`one of [...]` are all values that occur; use them exactly.")
    if "(ISO date)" in described:
        lines.append("`(ISO date)` is text; use CAST(x AS DATE) or CAST(x AS TIMESTAMP) to calculate with it.")
    lines.append("")
    basic = next(((t, f) for t, f in own.items() if len(f.flat) >= 2), None)
    if basic:
        t, f = basic
        a, b = quote(f.flat[0][0]), quote(f.flat[1][0])
        lines += ["## Basic query", "```sql", f"SELECT {a}, {b} FROM {quote(t)} WHERE {a} IS NOT NULL ORDER BY {b} NULLS LAST LIMIT 10", "```", ""]
    nested = next(((t, f.nested[0]) for t, f in own.items() if f.nested), None)
    if nested:
        t, name = nested
        inner = next(iter(record_shape(tables[t]).fields[name].fields))
        lines += ["## Fields of structs", "Use dots:", "```sql", f"SELECT x.{quote(name)}.{quote(inner)} FROM {quote(t)} x LIMIT 10", "```", ""]
    array = next(((t, *pair) for t, f in own.items() for pair in sorted(f.arrays, key=lambda p: p[1] != "object")), None)
    if array:
        t, name, kind = array
        shape = record_shape(tables[t]).fields[name]
        inner = next(iter(shape.item.fields), None) if kind == "object" and shape.item and shape.item.fields else None
        item = f"item.{quote(inner)}" if inner else "item"
        lines += ["## Arrays", "An array has to be exploded in a subquery before its items can be filtered or grouped:", "```sql", f"SELECT {item}, COUNT(*) AS n FROM (SELECT explode(x.{quote(name)}) AS item FROM {quote(t)} x) GROUP BY {item}", "```"]
        lines += ["The first item is get(arr, 0); get() counts from 0 and gives NULL beyond the end. size(arr) counts items.", "```sql", f"SELECT size(x.{quote(name)}) AS n, get(x.{quote(name)}, 0) AS first_item FROM {quote(t)} x LIMIT 10", "```"]
        plain = next(((t2, n2) for t2, f2 in own.items() for n2, k2 in f2.arrays if k2 == "str"), None)
        if plain:
            lines += ["Test for a value with array_contains:", "```sql", f"SELECT COUNT(*) AS n FROM {quote(plain[0])} x WHERE array_contains(x.{quote(plain[1])}, 'value')", "```"]
        lines.append("")
    if len(own) >= 2:
        keys = join_keys(own)
        lines.append("## Joins")
        if keys:
            lines.append("Fields that belong together: " + ", ".join(f"`{quote(a)}.{quote_path(f)} = {quote(b)}.{quote_path(g)}`" for a, f, b, g in keys[:12]))
            a, f, b, g = keys[0]
            lines += ["```sql", f"SELECT a.*, b.* FROM {quote(a)} a JOIN {quote(b)} b ON a.{quote_path(f)} = b.{quote_path(g)} LIMIT 10", "```"]
        else:
            lines.append("No field clearly belongs to one of another table; join only on fields with the same meaning.")
        exploded = _exploded_join(tables, own)
        if exploded:
            lines += ["Items of an array join after they are exploded:", "```sql", exploded, "```"]
        lines.append("")
    lines += ["## Functions", "Text: UPPER, LOWER, LENGTH, CONTAINS, LIKE. Numbers: ROUND, ABS, CEIL, FLOOR, try_divide. Dates: CAST AS DATE, DATE_TRUNC, EXTRACT, CURRENT_DATE.", "Aggregates: COUNT, SUM, AVG, MIN, MAX, COUNT(DISTINCT x), FILTER (WHERE ...), array_agg. Windows: ROW_NUMBER, RANK, LAG, LEAD. Arrays: explode, size, get, array_contains.", ""]
    lines += ["## Common mistakes", "- UNNEST, list_contains and QUALIFY don't exist: use explode, array_contains, and a subquery with WHERE.", "- arr[0] fails beyond the end of an array: use get(arr, 0).", "- \"x\" in double quotes is a name, 'x' in single quotes is text.", "- x / 0 is an error: use try_divide(x, y).", "- Two explode() in one SELECT multiply rows: use inline(arrays_zip(a, b)).", "", "# YOUR DATA", "", described]
    return "\n".join(lines)


def _exploded_join(tables: dict[str, Shape | None], own: dict[str, Fields]) -> str | None:
    for t, fields in own.items():
        for name, kind in fields.arrays:
            item = record_shape(tables[t]).fields[name].item
            if kind != "object" or item is None or not item.fields:
                continue
            inside = Fields(flat=[(k, _kind(s)) for k, s in item.fields.items() if _kind(s)])
            for other, theirs in own.items():
                if other != t:
                    for _, f, _, g in join_keys({name: inside, other: Fields(flat=theirs.flat)}):
                        return f"SELECT o.*, i.item FROM (SELECT explode(x.{quote(name)}) AS item FROM {quote(t)} x) i JOIN {quote(other)} o ON i.item.{quote(f)} = o.{quote(g)} LIMIT 10"
    return None

"""Facts about JSON records: for each path and kind of value, mergeable aggregates over all records.

One pass over the records serves inference, structure, samples and statistics. Each partition folds its records into
one row for each (path, kind), Spark merges the rows, and the driver gets as many rows as there are paths and kinds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.idents import ISO_DATE
from tessera.sources import json_text as J

KINDS = ("str", "int", "float", "bool", "null", "object", "array")
PRIMITIVES = ("str", "int", "float", "bool", "null")
ITEM = "["  # a step into an array; a step to a key is "." and the key
UNIQUE_CHARS = 100
#: Groups in which the partitions' facts are merged first.
MERGE_GROUPS = 64
#: Paths and kinds that the driver takes; keys that are data would make them as many as the records.
MAX_PATHS = 1_000_000
#: Characters of a sample value that leave an executor.
SAMPLE_CHARS = 4096
_NAMES = {str: "str", int: "int", float: "float", bool: "bool", type(None): "null", dict: "object", list: "array"}
_FACT = "path array<string>, kind string, n bigint, low double, high double, total double, n_empty bigint, big boolean, size bigint, size_low bigint, size_high bigint, extra bigint, per_low bigint, per_high bigint, parents bigint, dates boolean, uniq array<string>, samples array<struct<h:bigint,ord:bigint,v:string>>"


class _Cell:
    __slots__ = ("n", "low", "high", "total", "empty", "big", "size", "size_low", "size_high", "extra", "per_low", "per_high", "parents", "dates", "uniq", "samples")

    def __init__(self):
        self.n = self.empty = self.size = self.extra = self.parents = self.per_high = self.size_high = 0
        self.low = self.high = self.per_low = self.size_low = None
        self.total, self.big, self.dates = 0.0, False, True
        self.uniq: set = set()
        self.samples: list = []


class _Node:
    __slots__ = ("path", "cells", "keys", "item")

    def __init__(self, path: tuple[str, ...]):
        self.path, self.cells, self.keys, self.item = path, {}, {}, None


class _Folder:
    """Folds decoded records into nodes."""

    def __init__(self, k: int, max_unique: int, seed: int):
        self.root, self.k, self.max_unique, self.seed, self.state, self.order = _Node(()), k, max_unique, seed, 0, 0

    def record(self, rec_id: int, value) -> None:
        self.state = (rec_id * 0x9E3779B97F4A7C15 ^ self.seed * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        self.order = rec_id << 24
        self._fold(self.root, value)

    def _fold(self, node: _Node, value) -> str:
        kind = _NAMES[type(value)]
        cell = node.cells.get(kind)
        if cell is None:
            cell = node.cells[kind] = _Cell()
        cell.n += 1
        if kind == "str":
            length = len(value)
            size = length + 2 + value.count('"') + value.count("\\")
            measure = length
            cell.empty += not length
            if cell.dates and not ISO_DATE.fullmatch(value):
                cell.dates = False
        elif kind == "object":
            measure, size = len(value), 2
            cell.empty += not value
            cell.extra += sum(len(k) + 3 for k in value) + max(0, measure - 1)
        elif kind == "array":
            measure, size = len(value), 2
            cell.empty += not value
            cell.extra += max(0, measure - 1)
        elif kind == "null":
            measure, size = 0, 4
        elif kind == "bool":
            measure, size = 0, 5 if value else 4
            cell.empty += value  # how many are true
        else:
            text = str(value)
            measure, size = float(text), len(text)
            if kind == "int" and not -(1 << 63) <= value < 1 << 63:
                cell.big = True
        cell.total += measure
        if cell.low is None or measure < cell.low:
            cell.low = measure
        if cell.high is None or measure > cell.high:
            cell.high = measure
        cell.size += size
        if cell.size_low is None or size < cell.size_low:
            cell.size_low = size
        if size > cell.size_high:
            cell.size_high = size
        if kind == "object":
            for key, child in value.items():
                below = node.keys.get(key)
                if below is None:
                    below = node.keys[key] = _Node((*node.path, "." + key))
                self._fold(below, child)
        elif kind == "array":
            if node.item is None:
                node.item = _Node((*node.path, ITEM))
            seen: dict[str, int] = {}
            for child in value:
                k = self._fold(node.item, child)
                seen[k] = seen.get(k, 0) + 1
            for k, count in seen.items():
                below = node.item.cells[k]
                below.parents += 1
                below.per_high = max(below.per_high, count)
                below.per_low = count if below.per_low is None else min(below.per_low, count)
        elif kind != "null":
            if len(cell.uniq) < self.max_unique and (kind != "str" or measure <= UNIQUE_CHARS):
                cell.uniq.add(value)
            # The k values with the smallest pseudo-random marks; a mark follows from the record, so a rerun gives the same.
            self.state = (self.state * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
            self.order += 1
            mark = self.state >> 1
            kept = cell.samples
            if len(kept) < self.k:
                kept.append((mark, self.order, value))
            elif self.k and mark < (worst := max(kept))[0]:
                kept.remove(worst)
                kept.append((mark, self.order, value))
        return kind

    def rows(self) -> list[tuple]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            for kind, c in node.cells.items():
                samples = [{"h": h, "ord": o, "v": J.dumps(v[:SAMPLE_CHARS] if kind == "str" else v)} for h, o, v in c.samples]
                out.append((list(node.path), kind, c.n, c.low, c.high, c.total, c.empty, c.big, c.size, c.size_low, c.size_high, c.extra, c.per_low, c.per_high, c.parents, c.dates, [J.dumps(v) for v in c.uniq], samples))
            stack += node.keys.values()
            if node.item is not None:
                stack.append(node.item)
        return out


def collect_facts(raw: DataFrame, k: int = 3, max_unique: int = 100, seed: int = 12345) -> Facts:
    """The facts of raw(rec_id, raw); a record that isn't strict JSON fails the job."""
    names = [x.split()[0] for x in _FACT.split(", ")]

    def run(batches):
        folder = _Folder(k, max_unique, seed)
        for batch in batches:
            for rec_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is not None:
                    folder.record(rec_id, J.loads(text))
        rows = folder.rows()
        if rows:
            kinds = [pa.list_(pa.string()), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), *[pa.int64()] * 7, pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("h", pa.int64()), ("ord", pa.int64()), ("v", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    parts = raw.select("rec_id", "raw").mapInArrow(run, _FACT)
    sums = [F.sum(c).alias(c) for c in ("n", "total", "n_empty", "size", "extra", "parents")]
    ends = [F.min(c).alias(c) for c in ("low", "size_low", "per_low")] + [F.max(c).alias(c) for c in ("high", "size_high", "per_high")]
    lists = [
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("uniq")))), 1, max(1, max_unique)).alias("uniq"),
        F.slice(F.array_sort(F.flatten(F.collect_list("samples"))), 1, max(1, k)).alias("samples"),
    ]
    every = [*sums, *ends, F.bool_or("big").alias("big"), F.bool_and("dates").alias("dates"), *lists]
    # In two steps, so that no group holds the lists of all partitions at once.
    merged = parts.withColumn("part", F.spark_partition_id() % MERGE_GROUPS).groupBy("path", "kind", "part").agg(*every).groupBy("path", "kind").agg(*every)
    facts = Facts(k=k, max_unique=max_unique)
    found = merged.limit(MAX_PATHS + 1).collect()
    if len(found) > MAX_PATHS:
        raise ValueError(f"over {MAX_PATHS:,} different paths: objects with data as their keys have to become arrays first")
    for row in found:
        facts.cells.setdefault(tuple(row["path"]), {})[row["kind"]] = row.asDict(recursive=True)
    return facts


@dataclass
class Facts:
    """Merged facts on the driver: one entry for each path and kind."""

    k: int = 3
    max_unique: int = 100
    cells: dict[tuple[str, ...], dict[str, dict]] = field(default_factory=dict)
    #: Whether these are facts of all records; else values that occur may be missing.
    complete: bool = True

    def __post_init__(self):
        self._children: dict[tuple[str, ...], list[str]] | None = None

    def at(self, path: tuple[str, ...]) -> dict[str, dict]:
        return self.cells.get(path, {})

    def keys(self, path: tuple[str, ...]) -> list[str]:
        """The keys of objects at path, sorted."""
        if self._children is None:
            self._children = {}
            for p in self.cells:
                if p and p[-1] != ITEM:
                    self._children.setdefault(p[:-1], []).append(p[-1][1:])
            for names in self._children.values():
                names.sort()
        return self._children.get(path, [])

    def values(self, path: tuple[str, ...], kinds: tuple[str, ...] = PRIMITIVES) -> list:
        """Up to k sample values at path, in input order, repeats left out."""
        found = sorted((s["h"], s["ord"], s["v"]) for kind in kinds for s in self.at(path).get(kind, {}).get("samples", ()))
        out = []
        for _, _, text in sorted(found[: self.k], key=lambda s: s[1]):
            value = J.loads(text)
            if not any(type(value) is type(v) and value == v for v in out):
                out.append(value)
        return out

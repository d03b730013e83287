"""Statistics for each path of some JSON, from facts."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessera.operators.facts import ITEM, Facts
from tessera.sources.json_text import dumps, loads


def size_text(n: float) -> str:
    for unit, bytes_of in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= bytes_of:
            return f"{n / bytes_of:.2f} {unit}"
    return f"{int(n)} B"


def path_text(path: tuple[str, ...], root: str) -> str:
    return "$" + "[]" * (root == "array") + "".join("[]" if p == ITEM else p for p in path)


@dataclass
class Measure:
    """A count with least, greatest and summed value."""

    count: int = 0
    low: float | None = None
    high: float | None = None
    total: float = 0.0
    empty: int = 0

    @property
    def mean(self) -> float:
        return self.total / self.count if self.count else 0.0

    def add(self, cell: dict | None) -> Measure:
        if cell:
            self.count += cell["n"]
            self.total += cell["total"]
            self.empty += cell["n_empty"]
            self.low = cell["low"] if self.low is None else min(self.low, cell["low"])
            self.high = cell["high"] if self.high is None else max(self.high, cell["high"])
        return self


@dataclass
class FieldStats:
    path: str
    total_seen: int = 0
    null_count: int = 0
    type_counts: dict[str, int] = field(default_factory=dict)
    numbers: Measure = field(default_factory=Measure)
    strings: Measure = field(default_factory=Measure)
    arrays: Measure = field(default_factory=Measure)
    objects: Measure = field(default_factory=Measure)
    bool_true_count: int = 0
    bool_false_count: int = 0
    key_counts: dict[str, int] = field(default_factory=dict)
    unique_values: list = field(default_factory=list)
    unique_limit: int = 100
    total_size: int = 0
    size_min: int = 0
    size_max: int = 0

    def facts(self) -> dict[str, str]:
        """What is known of the path, by heading; headings without anything to tell are left out."""
        out = {"kinds": " + ".join(f"{n:,} {t}" for t, n in sorted(self.type_counts.items(), key=lambda x: (-x[1], x[0])))}
        out["bytes"] = f"{size_text(self.total_size)}, each {size_text(self.size_min)} to {size_text(self.size_max)}"
        if self.numbers.count:
            out["numbers"] = f"{self.numbers.low:g} to {self.numbers.high:g}, mean {self.numbers.mean:.6g}"
        for heading, m in (("characters", self.strings), ("elements", self.arrays), ("keys", self.objects)):
            if m.count:
                out[heading] = f"{m.low:g} to {m.high:g}, mean {m.mean:.3g}" + f", none in {m.empty:,}" * bool(m.empty)
        if self.bool_true_count + self.bool_false_count:
            out["true"] = f"{self.bool_true_count:,} of {self.bool_true_count + self.bool_false_count:,}"
        if self.unique_values:
            n = len(self.unique_values)
            shown = ", ".join(dumps(v) for v in sorted(self.unique_values, key=str)[:6])
            out["values"] = (f"{n} or more" if n >= self.unique_limit else f"{n}") + f" different: {shown}" + ", ..." * (n > 6)
        if self.key_counts and self.objects.count:
            rare = sorted(((n, k) for k, n in self.key_counts.items() if n < self.objects.count))
            if rare:
                out["not in all"] = ", ".join(f"{k} ({n:,})" for n, k in rare[:8]) + f" and {len(rare) - 8} more" * (len(rare) > 8)
        return out


@dataclass
class StatsResult:
    field_stats: dict[str, FieldStats]
    total_values: int = 0
    total_objects: int = 0
    total_arrays: int = 0
    total_primitives: int = 0
    total_size_bytes: int = 0
    max_depth: int = 0
    collection_time: float = 0.0

    def largest(self) -> list[FieldStats]:
        return sorted(self.field_stats.values(), key=lambda f: (-f.total_size, f.path))

    def __str__(self) -> str:
        return report(self, top_n=20)


def stats_of(facts: Facts, root: str, n_records: int, seconds: float = 0.0) -> StatsResult:
    """One FieldStats for each path; of an array root also one for the root, at $."""
    out = StatsResult({}, collection_time=seconds)
    for path, kinds in sorted(facts.cells.items()):
        name = path_text(path, root)
        f = FieldStats(name, unique_limit=facts.max_unique)
        f.type_counts = {k: c["n"] for k, c in kinds.items()}
        f.total_seen = sum(f.type_counts.values())
        f.null_count = f.type_counts.get("null", 0)
        f.numbers.add(kinds.get("int")).add(kinds.get("float"))
        f.strings.add(kinds.get("str"))
        f.arrays.add(kinds.get("array"))
        f.objects.add(kinds.get("object"))
        if "bool" in kinds:
            f.bool_true_count = kinds["bool"]["n_empty"]
            f.bool_false_count = kinds["bool"]["n"] - f.bool_true_count
        f.key_counts = {k: sum(c["n"] for c in facts.at((*path, "." + k)).values()) for k in facts.keys(path)}
        f.unique_values = [loads(v) for c in kinds.values() for v in c["uniq"]][: facts.max_unique]
        f.total_size = sum(c["size"] for c in kinds.values())
        f.size_min, f.size_max = min(c["size_low"] for c in kinds.values()), max(c["size_high"] for c in kinds.values())
        out.field_stats[name] = f
        out.total_values += f.total_seen
        out.total_objects += f.objects.count
        out.total_arrays += f.arrays.count
        out.total_size_bytes += f.total_size + sum(c["extra"] for c in kinds.values())
        out.max_depth = max(out.max_depth, len(path) + (root == "array"))
    if root == "array":
        f = FieldStats("$", 1, 0, {"array": 1}, arrays=Measure(1, n_records, n_records, n_records, int(not n_records)), total_size=2, size_min=2, size_max=2)
        out.field_stats = {"$": f} | out.field_stats
        out.total_values += 1
        out.total_arrays += 1
        out.total_size_bytes += 2 + max(0, n_records - 1)
    out.total_primitives = out.total_values - out.total_objects - out.total_arrays
    return out


#: How a report begins, and how its count of values.
TITLE, COUNT = "JSON STATISTICS", "Total values:"


def _summary(stats: StatsResult) -> list[str]:
    return [
        f"{TITLE} of {len(stats.field_stats):,} paths, {stats.max_depth} levels deep",
        f"{COUNT} {stats.total_values:,} = {stats.total_objects:,} objects + {stats.total_arrays:,} arrays + {stats.total_primitives:,} primitives; {size_text(stats.total_size_bytes)} of JSON; gathered in {stats.collection_time:.2f} s",
    ]


def report(stats: StatsResult, top_n: int = 50) -> str:
    """The totals, then a paragraph for each of the paths that take most bytes."""
    lines = _summary(stats)
    for f in stats.largest()[:top_n]:
        lines += ["", f"{f.path}  ({100 * f.total_size / max(1, stats.total_size_bytes):.3g} % of all bytes)", *(f"    {heading}: {text}" for heading, text in f.facts().items())]
    left = len(stats.field_stats) - top_n
    return "\n".join([*lines, *["", f"{left:,} more paths are smaller"] * (left > 0)])


def compact_report(stats: StatsResult) -> str:
    """The totals, and a line for each kind of value over all paths."""
    fields = list(stats.field_stats.values())
    lines = _summary(stats)
    for kind, measure, unit in (("object", "objects", "keys"), ("array", "arrays", "elements"), ("str", "strings", "characters"), ("int", None, ""), ("float", None, ""), ("bool", None, ""), ("null", None, "")):
        n = sum(f.type_counts.get(kind, 0) for f in fields)
        if not n:
            continue
        text = f"{kind}: {n:,} in {sum(kind in f.type_counts for f in fields):,} paths"
        if measure:
            held = [m for m in (getattr(f, measure) for f in fields) if m.count]
            text += f", {min(m.low for m in held):g} to {max(m.high for m in held):g} {unit}, {sum(m.empty for m in held):,} empty"
        elif kind == "bool":
            text += f", {sum(f.bool_true_count for f in fields):,} true"
        lines.append(text)
    numbers = [f.numbers for f in fields if f.numbers.count]
    if numbers:
        lines.append(f"numbers: {min(m.low for m in numbers):g} to {max(m.high for m in numbers):g}, mean {sum(m.total for m in numbers) / sum(m.count for m in numbers):.6g}")
    return "\n".join(lines)

"""The shape of JSON values, from facts, and four ways to print it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

from tessera.functions.idents import quote
from tessera.operators.facts import ITEM, KINDS, PRIMITIVES, Facts
from tessera.sources.json_text import dumps

#: A text field is shown by all its values if there are at most so many characters in each and values in all.
ENUM_CHARS, ENUM_VALUES = 48, 32
MORE = "…"


@dataclass
class Shape:
    """What stands at a path: kinds of primitives, an object's fields, an array's items; cut: more lies below."""

    path: tuple[str, ...]
    primitives: tuple[str, ...] = ()
    fields: dict[str, Shape] | None = None
    lengths: tuple[int, int] | None = None
    items: dict[str, tuple[int, int]] = field(default_factory=dict)
    item: Shape | None = None
    cut: bool = False

    @property
    def is_array(self) -> bool:
        return self.lengths is not None


def shape_of(facts: Facts, path: tuple[str, ...] = (), depth: int = 32, max_keys: int | None = None) -> Shape:
    """All records count, so a key of the last record is there like one of the first. Keys are sorted."""
    at = facts.at(path)
    out = Shape(path, tuple(k for k in PRIMITIVES if k in at))
    if "object" in at:
        out.fields = {}
        names = facts.keys(path)
        if depth <= 0:
            out.cut = bool(names)
        else:
            if max_keys is not None and len(names) > max_keys:
                names, out.cut = names[:max_keys], True
            out.fields = {k: shape_of(facts, (*path, "." + k), depth - 1, max_keys) for k in names}
    if "array" in at:
        arrays = at["array"]
        below = facts.at((*path, ITEM))
        out.lengths = (int(arrays["low"]), int(arrays["high"]))
        out.items = {k: (below[k]["per_low"] if below[k]["parents"] == arrays["n"] else 0, below[k]["per_high"]) for k in KINDS if k in below}
        if depth <= 0:
            out.cut = out.cut or bool(below)
        elif below:
            out.item = shape_of(facts, (*path, ITEM), depth - 1, max_keys)
    return out


def root_shape(facts: Facts, root: str, n_records: int, depth: int = 32, max_keys: int | None = None) -> Shape:
    """The shape of the whole source; for an array root, the array of its records."""
    if root != "array":
        return shape_of(facts, (), depth, max_keys)
    at = facts.at(())
    out = Shape((ITEM,), lengths=(n_records, n_records), items={k: (at[k]["n"], at[k]["n"]) for k in KINDS if k in at})
    if at:
        out.item = shape_of(facts, (), depth - 1, max_keys)
    return out


#: The kind of JSON that a column's value becomes in a sample; all others are text there.
_JSON_KINDS = {"long": "int", "integer": "int", "short": "int", "byte": "int", "double": "float", "float": "float", "boolean": "bool"}


def frame_shape(fields: T.StructType, facts: Facts, n_rows: int, depth: int = 32) -> Shape:
    """The shape of a frame's rows by its schema, which tells more than the rows from which facts are: all of its fields
    are there, and nulls are where the schema allows them and a row has one."""

    def of(kind: T.DataType, path: tuple[str, ...], depth: int) -> Shape:
        null = ("null",) if "null" in facts.at(path) else ()
        if isinstance(kind, T.StructType):
            if depth <= 0:
                return Shape(path, null, {}, cut=True)
            return Shape(path, null, {f.name: of(f.dataType, (*path, "." + f.name), depth - 1) for f in kind.fields})
        if isinstance(kind, T.ArrayType):
            seen, below = facts.at(path).get("array"), (*path, ITEM)
            lengths = (int(seen["low"]), int(seen["high"])) if seen else (0, 0)
            item = of(kind.elementType, below, depth - 1) if depth > 0 else None
            name = "object" if isinstance(kind.elementType, T.StructType) else "array" if isinstance(kind.elementType, T.ArrayType) else item.primitives[0] if item else "str"
            return Shape(path, null, lengths=lengths, items={name: lengths}, item=item, cut=depth <= 0)
        if isinstance(kind, T.MapType):
            return Shape(path, null, {})
        return Shape(path, (_JSON_KINDS.get(kind.typeName(), "float" if isinstance(kind, T.DecimalType) else "str"), *null))

    return Shape((ITEM,), lengths=(n_rows, n_rows), items={"object": (n_rows, n_rows)}, item=of(fields, (), depth - 1))


# ---- samples


@dataclass
class Samples:
    """How sample values are shown beside a type."""

    facts: Facts
    k: int = 3
    max_len: int = 60
    enum_max: int = 0

    def value(self, v) -> str:
        return dumps(v[: self.max_len] + MORE if isinstance(v, str) and len(v) > self.max_len else v)

    def suffix(self, path: tuple[str, ...], kinds: tuple[str, ...] = PRIMITIVES) -> str:
        if self.k <= 0:
            return ""
        at = {k: c for k, c in self.facts.at(path).items() if k in kinds and k != "null"}
        if not at:
            return " samples=[null]"
        tag = ""
        if set(at) == {"str"}:
            cell = at["str"]
            if cell["dates"]:
                tag = " (ISO date)"
            n = len(cell["uniq"])
            if not tag and cell["high"] <= ENUM_CHARS and 1 < n <= min(self.enum_max, ENUM_VALUES, self.facts.max_unique - 1) and cell["n"] >= 2 * n:
                return f" {'one' if self.facts.complete else 'e.g. one'} of [{', '.join(self.value(v) for v in sorted(map(_loads, cell['uniq'])))}]"
        return f"{tag} samples=[{', '.join(map(self.value, self.facts.values(path, kinds)[: self.k]))}]"


def _loads(text: str):
    from tessera.sources.json_text import loads

    return loads(text)


def count_label(low: int, high: int) -> str:
    return f"[{low}]" if low == high else f"[{low}..{high}]"


# ---- trees


@dataclass
class TreeNode:
    label: str
    children: list[TreeNode] = field(default_factory=list)


def to_tree(name: str, shape: Shape, samples: Samples) -> TreeNode:
    if shape.fields is None and not shape.is_array:
        return TreeNode(f"{name}: {'|'.join(shape.primitives) or 'unknown'}{samples.suffix(shape.path)}")
    node = TreeNode(name, [TreeNode(p + samples.suffix(shape.path, (p,))) for p in shape.primitives])
    node.children += [to_tree(k, s, samples) for k, s in (shape.fields or {}).items()]
    if shape.is_array:
        node.children += _item_nodes(shape, samples) if shape.items else [TreeNode("<empty> [0]")]
    if shape.cut:
        node.children.append(TreeNode(MORE))
    return node


def _item_nodes(shape: Shape, samples: Samples) -> list[TreeNode]:
    out = []
    inner = shape.item
    for kind, (low, high) in shape.items.items():
        node = TreeNode(f"{kind} {count_label(low, high)}")
        if kind in PRIMITIVES:
            node.label += samples.suffix(inner.path if inner else (*shape.path, ITEM), (kind,))
        elif inner is None:
            node.children.append(TreeNode(MORE))
        elif kind == "object":
            node.children = [to_tree(k, s, samples) for k, s in (inner.fields or {}).items()] + [TreeNode(MORE)] * inner.cut
        else:
            node.children.append(to_tree("<items>", Shape(inner.path, lengths=inner.lengths, items=inner.items, item=inner.item, cut=inner.cut), samples))
        out.append(node)
    return out


def root_tree(shape: Shape, label: str, samples: Samples) -> TreeNode:
    if shape.fields is not None:
        return TreeNode(label, to_tree("", Shape(shape.path, fields=shape.fields, cut=shape.cut), samples).children)
    return TreeNode(label, [to_tree("<value>", shape, samples)])


def print_tree(root: TreeNode) -> str:
    lines = [root.label]

    def below(node: TreeNode, prefix: str) -> None:
        for i, child in enumerate(node.children, 1):
            last = i == len(node.children)
            lines.append(f"{prefix}{'└── ' if last else '├── '}{child.label}")
            below(child, prefix + ("    " if last else "│   "))

    below(root, "")
    return "\n".join(lines)


def print_tabs(root: TreeNode, indent: str = "\t", level: int = 0) -> str:
    return "\n".join([indent * level + root.label, *(print_tabs(c, indent, level + 1) for c in root.children)])


def print_brackets(root: TreeNode, indent: str = "\t", level: int = 0) -> str:
    pad = indent * level
    if not root.children:
        return pad + root.label
    return "\n".join([f"{pad}{root.label} {{", *(print_brackets(c, indent, level + 1) for c in root.children), f"{pad}}}"])


# ---- schema

INLINE_FIELDS, INLINE_CHARS = 3, 30


def print_schema(shape: Shape, samples: Samples, max_depth: int | None = None, name: Callable[[str], str] = quote) -> str:
    """A compact notation like that of TypeScript: {a: int, b: [str], c: float?}; keys as Spark SQL spells them."""
    return _schema(shape, samples, max_depth, name, 0, False)


def _schema(shape: Shape, samples: Samples, max_depth: int | None, name, level: int, inline: bool) -> str:
    if max_depth is not None and level >= max_depth:
        short = ["{...}"] * bool(shape.fields) + ["[...]"] * shape.is_array + list(shape.primitives)
        return " | ".join(short) or "unknown"
    leaf = shape.fields is None and not shape.is_array
    simple = [p for p in shape.primitives if p != "null"]
    if leaf and len(simple) == 1:
        return simple[0] + "?" * ("null" in shape.primitives) + samples.suffix(shape.path)
    parts = []
    if shape.fields is not None:
        parts.append(_object(shape, samples, max_depth, name, level, inline))
    if shape.is_array:
        kinds = []
        for kind in shape.items:
            if kind in PRIMITIVES:
                kinds.append(kind + samples.suffix((*shape.path[:-1], ITEM) if shape.item is None else shape.item.path, (kind,)))
            elif shape.item is None:
                kinds.append("{...}" if kind == "object" else "[...]")
            else:
                only = shape.item
                part = Shape(only.path, fields=only.fields, cut=only.cut) if kind == "object" else Shape(only.path, lengths=only.lengths, items=only.items, item=only.item, cut=only.cut)
                kinds.append(_schema(part, samples, max_depth, name, level, True))
        parts.append(f"[{' | '.join(kinds)}]")
    if leaf and shape.primitives == ("null",):
        return "null" + samples.suffix(shape.path)
    return " | ".join(parts + list(shape.primitives)) or "unknown"


def _object(shape: Shape, samples: Samples, max_depth, name, level: int, inline: bool) -> str:
    lines = [f"{name(k)}: {_schema(s, samples, max_depth, name, level + 1, True)}" for k, s in shape.fields.items()]
    lines += [MORE] * shape.cut
    if not lines:
        return "{}"
    if inline and len(lines) <= INLINE_FIELDS and all(len(x) < INLINE_CHARS for x in lines):
        return "{" + ", ".join(lines) + "}"
    pad = "  " * level
    return "{\n" + "".join(f"{pad}  {x}\n" for x in lines) + pad + "}"
